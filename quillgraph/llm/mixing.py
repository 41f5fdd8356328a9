"""Temperature mixing of sources to target weights.

Token shares ``p`` of the sources are raised to an exponent and normalised: 1 keeps the natural mix, 0 makes all sources
equal. The exponent is bisected: the smallest one at which no source repeats more than ``max_repeat`` times, or the
largest at which the mix has at least ``target_entropy`` (as a share of the entropy of the equal mix). Six halvings are
taken per job, by trying 63 exponents at once; shares stay in a table, whatever the number of sources.

The weights are realised as budgeted block permutations. Each source is hashed into blocks, ``BLOCKS`` or as many as give
the largest source some ``BLOCK_TOKENS`` tokens in each, and every pass over a source takes them in another order until the pass's token budget is spent; of the block where the budget ends, documents
are taken in hash order, equal hashes together. Order and running sums are per block, so a source with most rows is no task
of its own. Without
a ``budget`` the tokens are such that the least repeated source is passed exactly once: nothing is left out.

A null ``source`` is a source of its own; null text has one token, as every text has at least one. Repeated rows are drawn
like others. With an empty table the mix is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

BLOCKS = 256  # at least
BLOCK_TOKENS = 1 << 24
STEPS = 63
JOBS = 5
PREFIX = "_qg_"


def n_tokens(text: Column) -> Column:
    """Spaces plus one: a JVM-side token estimate that is equal for equal texts."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long")


def exponent(shares: DataFrame, max_repeat: float | None, target_entropy: float | None) -> float:
    """Bisects the exponent on ``shares(tokens)``."""
    if (max_repeat is None) == (target_entropy is None):
        raise ValueError("give one of max_repeat and target_entropy")
    lo, hi = 0.0, 1.0
    total = shares.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total.t or total.n == 1:
        return 1.0
    lp = F.log(F.col("tokens") / F.lit(float(total.t)))
    for _ in range(JOBS):
        tries = [lo + (hi - lo) * i / (STEPS + 1) for i in range(1, STEPS + 1)]
        aggs = []
        for i, a in enumerate(tries):
            w = F.exp(lp * a)
            # repeats relative to the least repeated source: the ratio of largest to smallest w / p
            aggs += [F.max(w / F.exp(lp)).alias(f"r{i}"), F.min(w / F.exp(lp)).alias(f"m{i}"), F.sum(w).alias(f"z{i}"), F.sum(w * lp * a).alias(f"s{i}")]
        got = shares.agg(*aggs).first()

        def fits(i: int) -> bool:
            if max_repeat is not None:
                return got[f"r{i}"] / got[f"m{i}"] <= max_repeat
            return math.log(got[f"z{i}"]) - got[f"s{i}"] / got[f"z{i}"] >= target_entropy * math.log(total.n)

        ok = [fits(i) for i in range(STEPS)]
        if max_repeat is not None:  # holds from some exponent on
            k = ok.index(True) if True in ok else STEPS
            lo, hi = ([lo, *tries][k], [*tries, hi][k])
        else:  # holds up to some exponent
            k = ok.index(False) if False in ok else STEPS
            lo, hi = ([lo, *tries][k], [*tries, hi][k])
    return hi if max_repeat is not None else lo


def mixture(docs: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, seed: int = 11) -> DataFrame:
    """Rows of ``docs`` as often as the mix draws them, with all their columns and ``_qg_pass`` (from 0), ``_qg_order`` (rank of
    the block in that pass's permutation), ``_qg_tokens`` and ``_qg_weight`` (of the source)."""
    store = Scratch(docs.sparkSession)
    c = {n: PREFIX + n for n in ("source", "tokens", "block", "key", "pass", "order", "weight", "start", "need", "at", "sum", "passes", "goal", "total")}
    rows = docs.withColumns({c["source"]: F.to_json(F.struct(F.col("source").cast("string").alias("s"))), c["tokens"]: n_tokens(F.col("text"))})
    rows = rows.withColumn(c["key"], F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)))
    whole = rows.groupBy(c["source"]).agg(F.sum(c["tokens"]).alias("t")).agg(F.max("t")).first()[0] or 0
    n_blocks = max(BLOCKS, 1 << (-(-whole // BLOCK_TOKENS) - 1).bit_length()) if whole else BLOCKS
    rows = rows.withColumn(c["block"], F.pmod(c["key"], F.lit(n_blocks)).cast("int"))
    blocks = store.put("blocks", rows.groupBy(c["source"], c["block"]).agg(F.sum(c["tokens"]).alias("t")))
    shares = store.put("shares", blocks.groupBy(c["source"]).agg(F.sum("t").alias("tokens")))
    a = exponent(shares, max_repeat, target_entropy)
    total = shares.agg(F.sum("tokens").alias("t")).first().t or 1
    w = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    stat = shares.agg(F.sum(w).alias("z"), F.max(F.col("tokens") / w).alias("r")).first()
    z, r = stat.z or 1.0, stat.r or 0.0
    goal = F.round(w * F.lit(float(r))) if budget is None else F.round(w / F.lit(float(z)) * F.lit(float(budget)))
    plan = shares.select(c["source"], F.col("tokens").alias(c["total"]), goal.cast("long").alias(c["goal"]), (w / F.lit(float(z))).alias(c["weight"]))
    plan = plan.withColumn(c["passes"], F.ceil(F.col(c["goal"]) / F.col(c["total"])).cast("int")).filter(F.col(c["goal"]) > 0)
    # every pass: its need, and where each block starts in the pass's permutation
    passes = plan.withColumn(c["pass"], F.explode(F.sequence(F.lit(0), F.col(c["passes"]) - 1))).withColumn(c["need"], F.least(F.col(c["total"]), F.col(c["goal"]) - F.col(c["pass"]) * F.col(c["total"])))
    order = Window.partitionBy(c["source"], c["pass"]).orderBy(F.xxhash64(c["block"], c["pass"], F.lit(seed)), c["block"])
    dealt = blocks.join(passes, c["source"]).withColumns({c["order"]: F.row_number().over(order), c["start"]: F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")})
    dealt = store.put("passes", dealt.filter(F.col(c["start"]) < F.col(c["need"])))
    whole = dealt.filter(F.col(c["start"]) + F.col("t") <= F.col(c["need"])).select(c["source"], c["block"], c["pass"], c["order"], c["weight"])
    part = dealt.filter(F.col(c["start"]) + F.col("t") > F.col(c["need"])).select(c["source"], c["block"], c["pass"], c["order"], c["weight"], (F.col(c["need"]) - F.col(c["start"])).alias(c["at"]))
    keep = [*docs.columns, c["pass"], c["order"], c["tokens"], c["weight"]]
    on = [c["source"], c["block"]]
    # a block that ends a budget: one a source and pass, small, so its ids alone are put in order
    ends = rows.select(*on, c["key"], c["tokens"]).join(part, on).groupBy(*on, c["pass"], c["order"], c["weight"], c["at"], c["key"]).agg(F.sum(c["tokens"]).alias(c["sum"]))
    run = Window.partitionBy(*on, c["pass"]).orderBy(c["key"]).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn(c["start"], F.sum(c["sum"]).over(run) - F.col(c["sum"])).filter(F.col(c["start"]) < F.col(c["at"])).select(*on, c["key"], c["pass"], c["order"], c["weight"])
    lists = whole.groupBy(*on).agg(F.collect_list(F.struct(c["pass"], c["order"], c["weight"])).alias("_qg_draws"))
    full = rows.join(lists, on).withColumn("_qg_d", F.explode("_qg_draws")).withColumns({n: F.col("_qg_d")[n] for n in (c["pass"], c["order"], c["weight"])})
    return full.select(*keep).unionByName(rows.join(ends, [*on, c["key"]]).select(*keep))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture's rows with the columns of ``docs`` alone."""
    return mixture(docs, **options).select(*docs.columns)
