"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

1. One scan gives each document's set of distinct 5-word shingles as 64-bit hashes: its size, a fingerprint, a parity
   bitmap whose width follows the size band, and the prefix of shingles that two linked sets cannot both miss
   (``n - ceil(0.8 n) + 1`` of them in one global order: most frequent last, then by hash). Equal sets collapse by
   fingerprint, so copies never form pairs.
2. Documents that share a prefix shingle form a group. A first round checks each against a few leaders of its groups,
   which joins large groups of near copies at linear cost.
   Bitmaps bound the overlap first; what they leave is verified by exact intersection of the sorted arrays.
3. A group that still spans several components is a tile, or is cut into tiles by size band and hash where it is large.
   Tiles of one band or neighbouring bands meet; within them ``(|A| + |B| - popcount(a ^ b)) / 2`` bounds the overlap from above.
4. What passes is verified by exact intersection of the sorted arrays, and components follow from large-star and
   small-star rounds over the links.

Every linked pair of different sets shares a prefix shingle, so none is lost; there is no cap on groups or candidates.

Null or empty text: an empty set, linked with nothing. Rows with a null ``doc_id`` keep their ``n_shingles`` and get a
null component. An empty table gives an empty result; a very long text is a chunk of its own, and its set one array.
Repeated rows are all returned; rows of one ``doc_id`` with different texts are versions of one document,
linked if any version is. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._bits import bit_filter, has, without
from ._graph import components
from ._store import Scratch

FREQUENT = 1 << 16  # shingles ordered by frequency; a bound on what is broadcast, not on what is joined
LOCAL = 4  # documents of one chunk that must share a shingle before it is reported as frequent
TILE = 512  # rows of a tile
SEEN = 1 << 20  # pairs remembered, to look at each once; a repeated look costs time alone


def width(n: int) -> int:
    """Bits of the bitmap for sets of ``n``: a power of two near ``n``."""
    return max(64, min(8192, 1 << max(0, int(n) - 1).bit_length()))


def sets_of(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than ``k`` are one shingle, no words none."""
    w = T.words(col, T.SPACE, lower=True)
    h = w.hashes()
    full = T.shingles(h, k)
    for a, b in zip(w.rows[:-1].tolist(), w.rows[1:].tolist()):
        if b - a >= k:
            x = np.sort(full[a : b - k + 1])
            yield x[np.r_[True, x[1:] != x[:-1]]]
        elif b > a:
            yield T.shingles(h[a:b], b - a, 1)
        else:
            yield full[:0]


def fingerprint(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        y = T.mix(np.array([x.sum(dtype=np.uint64), (x * (x | np.uint64(1))).sum(dtype=np.uint64)]))
        return int((y[0] ^ (y[1] * np.uint64(0x9E3779B97F4A7C15))).view(np.int64))


def bitmap(x: np.ndarray) -> bytes:
    """Bit i is the parity of the number of hashes that fall on i."""
    n = width(len(x))
    return np.packbits((np.bincount((x >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def _profile(k: int):
    def run(batches):
        for part in T.chunks(batches, most=2 * T.CHUNK):
            ids = part.column(0).to_pylist()
            sets = list(sets_of(part.column(1), k))
            live = [i for i, x in enumerate(sets) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) if len(x) else None for x in sets], pa.int64()),
                 pa.array([bitmap(x) if len(x) else None for x in sets], pa.binary()), pa.nulls(len(ids), pa.int64())], ["doc_id", "n", "f", "bits", "often"])
            if live:
                h, c = np.unique(np.concatenate([sets[i] for i in live]), return_counts=True)
                h, c = h[c >= LOCAL], c[c >= LOCAL]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(c.astype(np.int64)), T.long(h), pa.nulls(len(h), pa.binary()), pa.array(np.ones(len(h), np.int64))], ["doc_id", "n", "f", "bits", "often"])

    return run


def _prefixes(k: int, num: int, den: int, late):
    def run(batches):
        often = late.value  # hashes, sorted; rank of each
        for part in T.chunks(batches):
            tok, own, size = [], [], []
            for x in sets_of(part.column(0), k):
                n = len(x)
                if not n:
                    continue
                p = n - -(-num * n // den) + 1
                if len(often[0]):
                    at = np.searchsorted(often[0], x)
                    at[at == len(often[0])] = 0
                    common = often[0][at] == x
                    order = np.r_[x[~common], x[common][np.argsort(often[1][at[common]], kind="stable")]][:p]
                else:
                    order = x[:p]
                tok.append(order)
                own.append(np.full(p, fingerprint(x), np.int64))
                size.append(np.full(p, n, np.int32))
            if tok:
                yield pa.RecordBatch.from_arrays([T.long(np.concatenate(tok)), pa.array(np.concatenate(own)), pa.array(np.concatenate(size))], ["t", "f", "n"])

    return run


def _bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """An upper bound on the overlap of two sets; the wider bitmap is folded, which keeps parity."""
    x, y, wx, wy = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a) * 8, len(b) * 8
    while wx > wy:
        wx //= 2
        x = (x >> wx) ^ (x & ((1 << wx) - 1))
    while wy > wx:
        wy //= 2
        y = (y >> wy) ^ (y & ((1 << wy) - 1))
    return (na + nb - (x ^ y).bit_count()) // 2


def linked(shared: int, na: int, nb: int, num: int, den: int) -> bool:
    return den * shared >= num * (na + nb - shared)


def _within(num: int, den: int):
    """Pairs whose bitmaps don't rule them out."""

    def run(batches):
        for part in batches:
            na, nb, x, y = (part.column(i).to_pylist() for i in range(2, 6))
            keep = [linked(_bound(p, q, m, n), m, n, num, den) for m, n, p, q in zip(na, nb, x, y)]
            yield part.select(["u", "v", "ru", "rv"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(batches):
        for part in batches:
            x, y = part.column(2), part.column(3)
            keep = []
            for i in range(part.num_rows):
                a, b = np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                keep.append(linked(int((both[1:] == both[:-1]).sum()), len(a), len(b), num, den))
            yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tiles(num: int, den: int):
    """Rows sorted by (lo, i, j, t): the groups in which two tiles meet, side 0 and 1 (equal tiles: side 0 alone). Groups
    of one key have mostly the same members, so each pair is looked at once for a key."""

    def meet(rows: list[tuple], seen: set, out: list) -> None:
        left = [r for r in rows if r[4] == 0]
        right = [r for r in rows if r[4] == 1]
        for a, (*_, fa, na, ca, ba) in enumerate(left):
            for *_, fb, nb, cb, bb in right or left[a + 1 :]:
                if ca != cb and den * min(na, nb) >= num * max(na, nb):
                    pair = (fa, fb) if fa < fb else (fb, fa)
                    if pair not in seen:
                        seen.add(pair)
                        if linked(_bound(ba, bb, na, nb), na, nb, num, den):
                            out.append(pair)

    def run(batches):
        key, rows, seen, out = None, [], set(), []
        for part in batches:
            for r in zip(*(c.to_pylist() for c in part.columns)):
                if r[:4] != key:
                    meet(rows, seen, out)
                    if key is None or r[:3] != key[:3] or len(seen) > SEEN:
                        seen = set()
                    key, rows = r[:4], []
                rows.append(r)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        meet(rows, seen, out)
        yield _pairs(out)

    return run


def _pairs(out: list) -> pa.RecordBatch:
    u, v = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``; links where ``den * overlap >= num * union``."""
    spark = docs.sparkSession
    store = Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scan = store.put("profile", docs.mapInArrow(_profile(k), "doc_id long, n long, f long, bits binary, often long"))
    late = scan.filter("often = 1").groupBy("f").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f").limit(FREQUENT).collect()
    rank = sorted((np.int64(r.f).view(np.uint64), i) for i, r in enumerate(reversed(late)))
    late = spark.sparkContext.broadcast((np.array([h for h, _ in rank], np.uint64), np.array([i for _, i in rank], np.int64)))
    rows = scan.filter("often is null").select("doc_id", "n", "f", "bits")
    nodes = store.put("nodes", rows.filter("f is not null").groupBy("f").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), F.first("bits").alias("bits")).filter("rep is not null"))

    group = Window.partitionBy("t")
    over = {"lo": F.min("f").over(group), "hi": F.max("f").over(group), "any": F.min(F.struct(F.xxhash64("f", "t").alias("h"), "f")).over(group)["f"]}
    found = docs.filter("doc_id is not null").select("text").mapInArrow(_prefixes(k, num, den, late), "t long, f long, n int").withColumns(over).filter("lo != hi")
    found = found.groupBy("t", "f").agg(*(F.first(c).alias(c) for c in ("n", "lo", "hi", "any")))
    every = store.put("every", found.withColumns({"s1": F.bit_xor(F.xxhash64("f")).over(group), "s2": F.bit_xor(F.xxhash64("f", F.lit(1))).over(group)}))
    # groups with the same members say the same: one of them stays
    once = every.groupBy("s1", "s2").agg(F.min("t").alias("t"))
    shared = store.put("shared", every.drop("s1", "s2").join(once.select("t"), "t", "left_semi"))

    def verified(name: str, pairs: DataFrame) -> DataFrame:
        side = lambda c: nodes.select(F.col("f").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("b" + c), F.col("rep").alias("r" + c))
        bounded = pairs.distinct().join(side("u"), "u").join(side("v"), "v").filter(F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num)
        pairs = store.put(name + "_pairs", bounded.select("u", "v", "nu", "nv", "bu", "bv", "ru", "rv").mapInArrow(_within(num, den), "u long, v long, ru long, rv long"))
        need = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("f"), F.col("ru").alias("rep")), F.struct(F.col("v").alias("f"), F.col("rv").alias("rep")))).alias("s")).select("s.*").distinct()
        few = spark.sparkContext.broadcast(bit_filter(need.select(F.col("rep").alias("h"))))
        # a doc_id with several texts gives several sets: the fingerprint tells which is meant
        sets = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(_named(k, few), "f long, x binary").join(need.select("f").distinct(), "f", "left_semi").groupBy("f").agg(F.first("x").alias("x"))
        sets = store.put(name + "_sets", sets)
        a, b = (sets.select(F.col("f").alias(c), F.col("x").alias("x" + c)) for c in ("u", "v"))
        return store.put(name, pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "xu", "xv").mapInArrow(_verify(num, den), "u long, v long"))

    # One leader of each kind a document: the one that most of its prefix shingles name.
    votes = shared.select("f", F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("lead")) for i, c in enumerate(("lo", "hi", "any"))))).alias("s")).select("f", "s.*").filter("f != lead")
    best = votes.groupBy("f", "kind", "lead").count().groupBy("f", "kind").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
    near = verified("near", best.select(F.least("f", "lead").alias("u"), F.greatest("f", "lead").alias("v")))
    first = components(near, store, "near")

    left = shared.select("t", "f", "n").join(first, "f", "left").select("t", "f", "n", F.coalesce("root", "f").alias("c"))
    left = left.withColumns({"lo": F.min("c").over(group), "hi": F.max("c").over(group), "size": F.count("*").over(group)}).filter("lo != hi")
    # a group above TILE is cut by size band and hash; a document is in the same tile of every group of that size
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size") / TILE))).cast("long")
    tile = F.when(F.col("size") <= TILE, F.lit(-1)).otherwise(F.floor(F.log("n") / math.log(den / num)) * (1 << 32) + F.pmod(F.xxhash64("f"), parts)).cast("long")
    left = store.put("left", left.select("t", "f", "n", "c", "lo", tile.alias("i")))
    tiles = left.groupBy("t", "lo", "i").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    other = tiles.select("t", F.col("i").alias("j"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    near_band = F.shiftright("j", 32) - F.shiftright("i", 32) <= 1
    meets = tiles.join(other, "t").filter((F.col("i") <= F.col("j")) & near_band & ((F.col("a") != F.col("b")) | (F.col("a2") != F.col("b2")) | (F.col("a") != F.col("a2")))).select("t", "lo", "i", "j")
    sides = meets.select("t", "lo", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("k", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    ready = sides.join(left.select("t", F.col("i").alias("k"), "f", "n", "c"), ["t", "k"]).join(nodes.select("f", "bits"), "f").select("lo", "i", "j", "t", "side", "f", "n", "c", "bits")
    found = ready.repartition("lo", "i", "j").sortWithinPartitions("lo", "i", "j", "t").mapInArrow(_tiles(num, den), "u long, v long")
    far = verified("far", found)
    own = rows.filter("f is not null and doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min("f").alias("u"), F.max("f").alias("v")).filter("u != v").select("doc_id", "u")
    versions = own.join(several, "doc_id").filter("f != u").select("u", F.col("f").alias("v")).distinct()
    links = near.unionByName(far).unionByName(versions)
    roots = components(links, store, "all")
    named = nodes.select("f", "rep").join(roots, "f", "left").select("f", "rep", F.coalesce("root", "f").alias("root"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = store.put("label", named.join(low, "root").select("f", "component_id"))
    store.drop("every", "shared", "left", "near_sets", "far_sets", "near_pairs", "far_pairs")
    return rows.join(label, "f", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _named(k: int, few):
    """Sets by fingerprint, of the documents whose id may be asked for."""

    def run(batches):
        bits = np.frombuffer(few.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(has(bits, batch.column(0).to_numpy().view(np.uint64))))
            for part in T.chunks([batch]):
                sets = [x for x in sets_of(part.column(1), k) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["f", "x"])

    return run


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose component has a smaller ``doc_id``; all columns, repeated rows once each."""
    gone = jaccard_components(docs, **options).filter("doc_id is not null and component_id < doc_id").select("doc_id").distinct()
    return without(docs, F.col("doc_id").cast("long"), Scratch(docs.sparkSession).put("gone", gone))
