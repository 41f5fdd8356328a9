"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of ``window`` words (a shorter item is one window). A document holds a window only if it
holds all its shingles, so the prefix that must be joined is one token: the window's rarest shingle in the corpus. The
corpus counts of item shingles are exact. Both scans test shingles against a bit array of fixed size, which lets a few
strangers through and loses none; nothing that grows with the data is broadcast. Candidates are joined on the token, the
token's place in the window bounds where the window can start and end, and the words themselves decide.

Null or empty text has no words. Results depend on the text alone, so equal texts are verified once; every row of the
documents comes back, repeated rows and null ``doc_id`` included. Windows of items with a null ``item_id`` or no words
are ignored. With an empty table on either side nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._bits import bit_filter, has, without
from ._store import Scratch

SHINGLE = 3


def _shingles(w: T.Words, h: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``g`` words within a row and where they start."""
    s = T.shingles(h, g)
    last = np.repeat(w.rows[1:], np.diff(w.rows))[: len(s)]
    at = np.flatnonzero(np.arange(len(s)) + g <= last)
    return s[at], at


def _spell(w: T.Words, a: int, b: int) -> bytes:
    return b" ".join(w.buf[s:e].tobytes() for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist()))


def _windows(window: int):
    """Distinct windows of an item with each shingle's place."""

    def run(batches):
        for part in T.chunks(batches):
            out = []
            w = T.words(part.column(1), T.ALNUM, lower=True)
            h = w.hashes()
            for item, a, b in zip(part.column(0).to_pylist(), w.rows[:-1].tolist(), w.rows[1:].tolist()):
                size = min(window, b - a)
                g = min(SHINGLE, size)
                for i in range(a, b - size + 1) if size else ():
                    s = T.shingles(h[i : i + size], g)
                    out.append((item, _spell(w, i, i + size).decode(), size, g, s.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())))], ["item", "window", "size", "g", "tokens"])

    return run


def _counts(bits, widths: list[int]):
    def run(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for part in T.chunks(batches):
            w = T.words(part.column(0), T.ALNUM, lower=True)
            h = w.hashes()
            for g in widths:
                s, _ = _shingles(w, h, g)
                t, n = np.unique(s[has(table, s)], return_counts=True)
                yield pa.RecordBatch.from_arrays([T.long(t), pa.array(n.astype(np.int64))], ["t", "n"])

    return run


def _candidates(bits, widths: list[int], window: int):
    """A row for each document (no token), then one for each place of a prefix token with the words around it."""
    fields = ["doc_id", "x", "n_words", "t", "pos", "at", "around"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for part in T.chunks(batches):
            w = T.words(part.column(2), T.ALNUM, lower=True)
            h, n, x = w.hashes(), part.num_rows, part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(w.rows).astype(np.int64)), *(pa.nulls(n, k) for k in kinds[3:])], fields)
            out = []
            for g in widths:
                s, at = _shingles(w, h, g)
                hit = has(table, s)
                owner = np.searchsorted(w.rows, at[hit], "right") - 1
                for t, p, o in zip(s[hit].view(np.int64).tolist(), at[hit].tolist(), owner.tolist()):
                    a, b = max(int(w.rows[o]), p - window + g), min(int(w.rows[o + 1]), p + window)
                    out.append((None, x[o], None, t, p - int(w.rows[o]), p - a, _spell(w, a, b).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], fields)

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, hits, matches)``: ``documents(doc_id, x, n_words)`` has all rows, ``x`` being the text's ``xxhash64``,
    ``hits(x, start, size)`` the places of windows, ``matches(x, item)`` the items they come from."""
    spark = docs.sparkSession
    store = Scratch(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("x"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")).filter("item is not null")
    cut = store.put("windows", items.mapInArrow(_windows(window), "item string, window string, size int, g int, tokens array<long>"))
    distinct = cut.groupBy("window").agg(*(F.first(c).alias(c) for c in ("size", "g", "tokens")))
    tokens = distinct.select("window", "size", "g", F.posexplode("tokens").alias("offset", "t"))
    widths = sorted(r.g for r in cut.select("g").distinct().collect())  # 1 to SHINGLE
    share = spark.sparkContext.broadcast
    seen = docs.select("text").mapInArrow(_counts(share(bit_filter(tokens.select(F.col("t").alias("h")))), widths), "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    # A shingle that no document holds rules its window out, so an inner join loses nothing once all tokens are counted.
    counted = tokens.join(seen, "t", "left").fillna(0, ["n"])
    prefix = store.put("prefix", counted.groupBy("window", "size").agg(F.min(F.struct("n", "t", "offset")).alias("r")).filter("r.n > 0").select("window", "size", "r.t", "r.offset"))
    found = store.put("found", docs.mapInArrow(_candidates(share(bit_filter(prefix.select(F.col("t").alias("h")))), widths, window), "doc_id long, x long, n_words long, t long, pos long, at int, around string"))
    near = found.filter("t is not null").select("x", "t", "pos", "at", "around").dropDuplicates(["x", "t", "pos"])
    start = F.col("at") - F.col("offset")
    around = F.split("around", " ")
    hits = (near.join(prefix, "t").filter((start >= 0) & (start + F.col("size") <= F.size(around)))
            .filter(F.array_join(F.slice(around, start + 1, F.col("size")), " ") == F.col("window")).select("x", (F.col("pos") - F.col("offset")).alias("start"), "size", "window"))
    hits = store.put("hits", hits)
    matches = hits.select("x", "window").distinct().join(cut.select("window", "item").distinct(), "window").select("x", "item").distinct()
    return found.filter("t is null").select("doc_id", "x", "n_words"), hits.select("x", "start", "size").distinct(), matches


def contaminated_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``."""
    rows, hits, matches = contamination(docs, items, **options)
    covered = hits.select("x", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy("x").agg(F.count("*").alias("n_hit"))
    names = matches.groupBy("x").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("names"))
    out = rows.join(covered.join(names, "x"), "x", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose text holds no window of an item, with all their columns."""
    _, hits, _ = contamination(docs, items, text=text, **options)
    return without(docs, F.xxhash64(docs[text].cast("string")), hits.select("x").distinct())
