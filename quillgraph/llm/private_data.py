"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Fixed patterns find the base spans. Identifiers among a text's candidates (numbers in groups, addresses, disguised addresses)
that a fixed pattern accepts whole are seeds; the words around candidates are lexical patterns. Patterns and instances form
a graph: a pattern is worth the mean of its instances, an instance what its best accepted pattern is worth, and seeds are
worth all. After a fixed number of rounds the candidates behind accepted patterns are spans too.

Places: the pieces between the matches of a pattern and the matches take turns, so a running sum of their lengths, by row,
gives code points. Patterns are possessive and begin where a run begins: time is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

KINDS = ("email", "ip", "card", "phone")
WHOLE = 1_000_000  # what a seed is worth
ACCEPT = 800_000  # what a pattern must be worth
SUPPORT = 3  # different instances worth ACCEPT or more that a pattern needs
ROUNDS = 3
REACH = 64  # code points around a candidate in which its words are looked for

_MAIL = "[A-Za-z0-9._%+-]"
_FREE = rf"(?:\G|(?<!{_MAIL}))"  # a run of such characters is tried once, from its start
#: The same matches as the patterns of the contract, without their backtracking.
BASE = {
    "email": rf"{_FREE}{_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?[\[(](?:at|AT|@)[\])]\x20?)"
_DOT = r"(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)"
NUMBER = r"(?:\+\(?|\(|(?<![A-Za-z0-9_]))[0-9](?:[\x20().-]{0,2}[0-9]){3,18}(?![A-Za-z0-9_])"
CANDIDATE = rf"{_FREE}{_MAIL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++|{NUMBER}"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """From the right, every second digit doubled and its digits added; a multiple of ten."""
    place = F.sequence(F.lit(1), F.length(d))

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(place, F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """The check of a base match beyond its pattern."""
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _shape(kind: str, m: Column) -> Column:
    """May the candidate be of this kind at all?"""
    n = F.length(_digits(m))
    if kind == "email":
        return m.rlike("[A-Za-z]")
    number = ~m.rlike("[A-Za-z]")
    if kind == "ip":
        return number & m.rlike(r"^[0-9]{1,3}(?:[\x20.-]{1,2}[0-9]{1,3}){3}$")
    return number & (n.between(12, 19) if kind == "card" else n.between(7, 15))


def _seed(kind: str, m: Column) -> Column:
    return m.rlike(f"^(?:{BASE[kind]})$") & _holds(kind, m)


def _pieces(text: Column, pattern: Column) -> tuple[Column, Column]:
    """Matches, and the pieces before, between and behind them (one more)."""
    return F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)


def _contexts(before: Column, behind: Column) -> list[Column]:
    """The lexical patterns of a place: the two words before it in its line, and the words on both sides. ``^`` is the start of the line, or the end of another candidate."""
    near = F.right(before, F.lit(REACH))
    line = F.lower(F.substring_index(near, "\n", -1))
    words = F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    starts = near.contains("\n") | (F.length(before) < REACH)
    words = F.when(starts, F.concat(F.array(F.lit("^")), words)).otherwise(words)
    after = F.lower(F.regexp_extract(F.left(behind, F.lit(REACH)), r"^[\x20\x09]*([^\x20\x09-\x0D]*)", 1))
    left = lambda n: F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")
    return [F.concat(F.lit("2 "), left(2)), F.concat(F.lit("1 "), left(1), F.lit(" | "), after)]


def _base_match(k: int, pieces: Column):
    def one(x: Column, i: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.length(x).alias("n"), _holds(KINDS[k], x).alias("ok"))

    return one


def candidates(docs: DataFrame, store: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(row, doc_id)``; ``base(row, kind, start, end)``; ``found(row, start, end, value, shapes, seeds, contexts)``.

    ``row`` numbers the rows of ``docs`` in a stored table, so repeated and null ids stay apart.
    """
    text = F.coalesce("text", F.lit(""))
    at = text.contains("@") | text.rlike(r"[\[(](?:at|AT)[\])]")
    t = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", at.alias("at"), F.when(at | text.rlike("[0-9]"), text).otherwise("").alias("text"))
    # where no address can be, the shorter patterns give the same and cost less
    every = {k: (F.when(F.col("at"), F.col("text")).otherwise("") if k == "email" else F.col("text"), F.lit(p)) for k, p in BASE.items()}
    every["any"] = F.col("text"), F.when(F.col("at"), CANDIDATE).otherwise(NUMBER)
    t = t.select("row", "doc_id", *(c.alias(f"{n}_{kind}") for kind, p in every.items() for n, c in zip("mp", _pieces(*p), strict=True)))
    parts = [F.transform(f"m_{kind}", _base_match(k, F.col(f"p_{kind}"))) for k, kind in enumerate(KINDS)]
    m, p = F.col("m_any"), F.col("p_any")

    def one(x: Column, i: Column) -> Column:
        value = F.when(x.rlike("[A-Za-z]"), F.regexp_replace(F.regexp_replace(F.lower(x), r"\x20?[\[(](?:at|@)[\])]\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?", ".")).otherwise(_digits(x))
        return F.struct(i.alias("i"), F.length(F.get(p, i)).alias("gap"), F.length(x).alias("n"), value.alias("value"), F.array(*(_shape(k, x) for k in KINDS)).alias("shapes"), F.array(*(_seed(k, x) for k in KINDS)).alias("seeds"), F.array(*_contexts(F.get(p, i), F.get(p, i + 1))).alias("contexts"))

    held = store.put("rows", t.select("row", "doc_id", F.concat(*parts).alias("base"), F.transform(m, one).alias("found")))
    ends = lambda *by: F.sum(F.col("s.gap") + F.col("s.n")).over(Window.partitionBy("row", *by).orderBy("s.i"))
    base = held.select("row", F.explode("base").alias("s")).repartition("row").select("row", F.col("s.k").alias("kind"), ends("s.k").alias("end"), "s.n", "s.ok")
    base = base.filter("ok").select("row", "kind", (F.col("end") - F.col("n")).alias("start"), "end")
    found = held.select("row", F.explode("found").alias("s")).repartition("row").select("row", ends().alias("end"), "s.n", "s.value", "s.shapes", "s.seeds", "s.contexts")
    found = store.put("found", found.select("row", (F.col("end") - F.col("n")).alias("start"), "end", "value", "shapes", "seeds", "contexts"))
    return held.select("row", "doc_id"), base, found


def patterns(found: DataFrame, store: Scratch, rounds: int = ROUNDS, accept: int = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """``kind, context, worth`` of the accepted patterns. All sums are of whole numbers, so the order of rows doesn't matter.

    A pattern's instances are the different candidates of its kind's shape in its context. ``worth`` is the mean of theirs,
    in millionths; patterns with fewer than ``support`` instances can't be accepted and leave at once.
    """
    kinds = F.explode(F.filter(F.transform(F.lit(list(range(len(KINDS)))), lambda k: F.when(F.get("shapes", k), F.struct(k.alias("kind"), F.get("seeds", k).alias("seed")))), lambda x: x.isNotNull())).alias("k")
    seen = found.select("value", "contexts", kinds).select("value", "k.kind", "k.seed", F.explode("contexts").alias("context"))
    pairs = seen.groupBy("kind", "context", "value").agg(F.max("seed").alias("seed"))
    large = pairs.groupBy("kind", "context").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    # a value that is a seed anywhere is one everywhere
    seeds = pairs.filter("seed").select("kind", "value").distinct().withColumn("worth", F.lit(WHOLE).cast("long"))
    pairs = store.put("pairs", pairs.select("kind", "context", "value").join(large, ["kind", "context"]))
    worth = store.put("worth0", seeds)
    out = None
    for i in range(rounds):
        rated = pairs.join(worth, ["kind", "value"], "left").groupBy("kind", "context", "n").agg(F.coalesce(F.sum("worth"), F.lit(0)).alias("s"), F.count_if(F.col("worth") >= accept).alias("good"))
        good = rated.withColumn("worth", F.expr("s div n")).filter((F.col("worth") >= accept) & (F.col("good") >= support))
        out = store.put(f"patterns{i + 1}", good.select("kind", "context", "worth"))
        best = pairs.join(out, ["kind", "context"]).groupBy("kind", "value").agg(F.max("worth").alias("worth"))
        if i + 1 < rounds:
            worth = store.put(f"worth{i + 1}", seeds.unionByName(best).groupBy("kind", "value").agg(F.max("worth").alias("worth")))
    return out


def discovered(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """``row, kind, start, end`` of the candidates in an accepted pattern; of several kinds the worthiest, then the first."""
    kinds = F.explode(F.filter(F.lit(list(range(len(KINDS)))), lambda k: F.get("shapes", k))).alias("kind")
    seen = found.select("row", "start", "end", "contexts", kinds).select("row", "start", "end", "kind", F.explode("contexts").alias("context"))
    best = seen.join(accepted, ["kind", "context"]).groupBy("row", "start", "end").agg(F.max(F.struct("worth", (-F.col("kind")).alias("k"))).alias("b"))
    return best.select("row", (-F.col("b.k")).alias("kind"), "start", "end")


def private_spans(docs: DataFrame, rounds: int = ROUNDS, accept: int = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256`` and ``spans`` (all, base and discovered) of every row of ``docs(doc_id, text)``.

    A discovered span that touches a base span is dropped. A null or empty text has no spans; an empty table gives no rows;
    repeated rows and null ids give a row each; a text of any length is read whole, its spans are one array; other columns
    are ignored. Of two kinds with equal worth the first of ``KINDS`` is taken.
    """
    store = Scratch(docs.sparkSession)
    rows, base, found = candidates(docs.select("doc_id", "text"), store)
    more = discovered(found, patterns(found, store, rounds, accept, support))
    spans = base.withColumn("base", F.lit(True)).unionByName(more.withColumn("base", F.lit(False))).repartition("row")
    order = ("start", "end", "kind", "base")
    earlier = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)  # running, not unbounded following: that is quadratic
    reach, following = F.max(F.when(F.col("base"), F.col("end"))).over(earlier), F.min(F.when(F.col("base"), F.col("start"))).over(later)
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("free", free).filter("base or free").select("row", F.struct("start", "kind", "end", "base").alias("s"))
    whole = rows.select("row", "doc_id", F.lit(None).cast(spans.schema["s"].dataType).alias("s")).unionByName(spans, allowMissingColumns=True)
    names = F.lit(list(KINDS))
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.count_if(F.col("s.base") & (F.col("s.kind") == k)).alias(f"n_{KINDS[k]}")
    out = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(count(k) for k in range(len(KINDS))), F.array_sort(F.collect_list("s")).alias("s"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.filter("s", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
