"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly under the law ``bytes``.

Groups of equal texts stay in one shard, unless a group alone is heavier than a shard in bytes, tokens or rows: such a
group, of which there are fewer than ``3 * shards``, is dealt by ``doc_id`` into pieces of at most ``1/PARTS`` of a shard.
Groups above ``1/PARTS`` of a shard, fewer than ``3 * shards * PARTS``, are packed one by one; all others share ``shards *
CELLS`` hash cells, which are packed as wholes. Items are taken in order of falling weight, equal ones by name: each goes
to the shard where the dot product of its vector with the residual capacity is highest. A last round moves and swaps items
between the fullest and the emptiest shard while that brings their bytes closer. The number of items depends on the number
of shards only, so the plan on the driver stays small at any size, and so does the map of items to shards that is broadcast.
Tokens are words as ``mixing.n_tokens`` estimates them: spaces plus one.

Slots count each shard's rows from 0 without a gap: sub-buckets of a shard are counted, the counts give each its first
slot, and rows are numbered within a sub-bucket, in order of ``doc_id``; no task orders a whole shard. The number of
sub-buckets follows the rows (``SUB_ROWS`` each). A very long text is its digest, length and tokens from the first scan on.

Null text has no bytes; null ``doc_id`` rows are placed too, by their text. Repeated rows each get a slot. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import Scratch

SHARDS = 40
PARTS = 64
CELLS = 256
SUB = 16
SUB_ROWS = 1 << 20
DIMS = ["bytes", "tokens", "rows"]
WEIGHT = np.array([4.0, 1.0, 1.0])  # the law is on bytes


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item vector (rows of ``items``)."""
    total = np.maximum(items.sum(0), 1e-9)
    v = items / total * shards  # a shard's capacity is 1 in every dimension
    left = np.ones((shards, v.shape[1]))
    out = np.zeros(len(v), np.int64)
    for i in np.lexsort((np.arange(len(v)), -(v * WEIGHT).sum(1))):
        s = int(np.argmax(left @ (v[i] * WEIGHT)))
        out[i] = s
        left[s] -= v[i]
    return level(items[:, 0], out, shards)


def level(size: np.ndarray, out: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Moves or swaps single items between the fullest and the emptiest shard while that narrows the gap."""
    for _ in range(rounds):
        load = np.bincount(out, weights=size, minlength=shards)
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        a, b = np.flatnonzero(out == hi), np.flatnonzero(out == lo)
        if gap <= 1 or not len(a):
            break
        b = b[np.argsort(size[b], kind="stable")]
        other = np.r_[0.0, size[b]]  # 0: a move
        want = size[a] - gap / 2
        at = np.clip(np.searchsorted(other, want), 0, len(other) - 1)
        at = np.where((at > 0) & (np.abs(other[at - 1] - want) < np.abs(other[at] - want)), at - 1, at)
        left = np.abs(gap - 2 * (size[a] - other[at]))
        i = int(left.argmin())
        if left[i] >= gap:
            break
        out[a[i]] = lo
        if at[i]:
            out[b[at[i] - 1]] = hi
    return out


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``."""
    spark = docs.sparkSession
    store = Scratch(spark)
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = store.put("rows", docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("crc"),
                                         (F.length(raw) - F.length(F.replace(raw, F.lit(" "))) + 1).cast("long").alias("tokens"), _digest(F.col("text").cast("string")).alias("digest")))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total.rows:
        return rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    full = [max(1.0, total[c] / shards) for c in DIMS]
    most = [max(1.0, x / PARTS) for x in full]
    sub = max(SUB, -(-total.rows // (shards * SUB_ROWS)))
    groups = rows.groupBy("digest").agg(*sums)
    heavy = groups.filter((F.col("bytes") > most[0]) | (F.col("tokens") > most[1]) | (F.col("rows") > most[2])).filter("rows > 1").collect()  # fewer than 3 * shards * PARTS
    parts = {r.digest: int(min(r.rows, max(-(-r[c] // m) for c, m in zip(DIMS, most)))) if any(r[c] > x for c, x in zip(DIMS, full)) else 1 for r in heavy}
    split = spark.createDataFrame(list(parts.items()), T.StructType([T.StructField("digest", T.StringType()), T.StructField("parts", T.IntegerType())]))
    placed = rows.join(F.broadcast(split), "digest", "left")
    cell = F.format_string("cell-%d", F.pmod(F.xxhash64("digest"), F.lit(shards * CELLS)))
    piece = F.concat_ws("-", "digest", F.pmod(F.xxhash64("doc_id", "crc"), F.col("parts")))
    placed = placed.withColumn("item", F.when(F.col("parts").isNull(), cell).otherwise(piece))
    vectors = placed.groupBy("item").agg(*sums).orderBy("item").toPandas()
    plan = list(zip(vectors["item"], pack(vectors[DIMS].to_numpy(float), shards).tolist()))
    plan = spark.createDataFrame(plan, T.StructType([T.StructField("item", T.StringType()), T.StructField("shard", T.IntegerType())]))
    dealt = placed.join(F.broadcast(plan), "item").withColumn("sub", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(sub)).cast("int"))
    dealt = store.put("dealt", dealt.select("doc_id", "size", "crc", "shard", "sub"))
    counts = dealt.groupBy("shard", "sub").count()
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("shard").orderBy("sub")) - F.col("count")).drop("count")
    slot = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "crc", "size")) - 1
    out = dealt.withColumn("at", slot).join(base, ["shard", "sub"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
