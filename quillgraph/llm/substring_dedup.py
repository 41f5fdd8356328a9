"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words; its minimiser is the smallest hash among its runs of ``m`` words. Consecutive windows
with one minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket, where all windows are sorted
and the smallest ``doc_id`` of each is known; what comes back are the runs of windows that a smaller ``doc_id`` also has.

Before that, one scan counts the minimisers. Only windows whose minimiser stands in two documents can repeat, so others
don't travel: a bit array of fixed size tells them, and lets a few strangers through. The ``HOT_KEYS`` most frequent
minimisers, when above ``HOT`` places, are not bucketed: each of their windows goes by its own words through a partial
aggregation and a join that Spark can split, so no bucket holds more than the greater of ``HOT`` places and one
``HOT_KEYS``-th of all. Windows are compared by two independent 64-bit hashes in a bucket, by their words on the hot way.

Null text or fewer than ``k`` words: nothing to remove. Rows with a null ``doc_id`` neither lose words nor cost others
theirs. An empty table gives an empty result; a very long text is a chunk of its own. Rows with one ``doc_id`` are one document: none makes the other lose words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._bits import bit_filter, has, split
from ._store import Scratch

HOT = 1 << 16  # places; their packed strings are some 8 MB
HOT_KEYS = 1 << 16
BITS = 27  # 16 MB
CHUNK = 1 << 20  # bytes of text whose windows are in memory at a time


def super_kmers(w: T.Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and one past the last window (as word numbers of the chunk) of every super-k-mer."""
    s = T.shingles(w.hashes(), m)
    n = max(0, len(w.starts) - k + 1)
    if not n:
        return s[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, at = s[:n].copy(), np.arange(n)
    for j in range(1, k - m + 1):
        better = s[j : j + n] < best
        np.copyto(best, s[j : j + n], where=better)
        at[better] = np.flatnonzero(better) + j
    last = np.repeat(w.rows[1:], np.diff(w.rows))[:n]
    inside = np.arange(n) + k <= last
    opens = inside.copy()
    opens[1:] &= ~(inside[:-1] & (at[1:] == at[:-1]))
    first = np.flatnonzero(opens)
    stop = inside.copy()
    stop[:-1] &= ~(inside[1:] & ~opens[1:])
    return best[first], first, np.flatnonzero(stop) + 1


def _stats(k: int, m: int):
    def run(batches):
        for part in T.chunks(batches, most=CHUNK):
            w = T.words(part.column(1))
            v, first, _ = super_kmers(w, k, m)
            if len(v):
                doc = part.column(0).to_numpy()[np.searchsorted(w.rows, first, "right") - 1]
                order = np.lexsort((doc, v))
                v, doc = v[order], doc[order]
                new = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                end = np.r_[new[1:], len(v)]
                yield pa.RecordBatch.from_arrays([T.long(v[new]), pa.array(doc[new]), pa.array(doc[end - 1]), pa.array((end - new).astype(np.int64))], ["v", "lo", "hi", "n"])

    return run


def _send(k: int, m: int, bits, hot, alone: bool):
    """Super-k-mers of shared minimisers: the hot ones window by window if ``alone``, else the others."""

    def run(batches):
        table, often = np.frombuffer(bits.value, np.uint8), hot.value
        for part in T.chunks(batches, most=CHUNK):
            w = T.words(part.column(2))
            v, first, stop = super_kmers(w, k, m)
            keep = has(table, v)
            v, first, stop = v[keep], first[keep], stop[keep]
            if not len(v):
                continue
            mine = np.isin(v, often) == alone
            v, first, stop = v[mine], first[mine], stop[mine]
            if not len(v):
                continue
            n = stop - first if alone else np.ones(len(v), np.int64)
            each = np.repeat(np.arange(len(v)), n)
            a = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            b = a + 1 if alone else stop[each]
            row = np.searchsorted(w.rows, a, "right") - 1
            data, s, e = w.buf.tobytes(), w.starts.tolist(), w.ends.tolist()
            packed = [b" ".join([data[x:y] for x, y in zip(s[i:j], e[i:j])]) for i, j in zip(a.tolist(), (b + k - 1).tolist())]
            ids = part.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [T.long(v[each]), pa.array(ids), part.column(1).take(pa.array(row)), pa.array((a - w.rows[row]).astype(np.int32)), pa.array(packed, pa.binary()).cast(pa.string())],
                ["v", "doc", "row", "start", "words"],
            )

    return run


def _buckets(k: int):
    """Runs of windows, as first window and one past the last, that a smaller document of the bucket also has."""

    def run(batches):
        for part in T.whole_groups(batches, "v", CHUNK):
            w = T.words(part.column(4))
            h = w.hashes()
            x, y = T.shingles(h, k), T.shingles(h, k, 1)
            last = np.repeat(w.rows[1:], np.diff(w.rows))[: len(x)]
            at = np.flatnonzero(np.arange(len(x)) + k <= last)
            x, y = x[at], y[at]
            own = np.searchsorted(w.rows, at, "right") - 1
            doc = part.column(1).to_numpy()[own]
            order = np.lexsort((doc, y, x))
            xs, ys, ds = x[order], y[order], doc[order]
            new = np.r_[True, (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])]
            low = ds[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            dup = np.zeros(len(x), bool)
            dup[order] = low < ds
            hit = np.flatnonzero(dup)
            if not len(hit):
                continue
            cut = np.r_[True, (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)]
            head, tail = hit[cut], hit[np.r_[np.flatnonzero(cut)[1:] - 1, len(hit) - 1]]
            row = own[head]
            base = part.column(3).to_numpy()[row] - w.rows[row]
            yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(row)), pa.array((base + at[head]).astype(np.int32)), pa.array((base + at[tail] + 1).astype(np.int32))], ["row", "a", "b"])

    return run


def _strip(k: int, with_text: bool):
    def run(batches):
        for part in T.chunks(batches, "text", CHUNK):
            n, gone, sha, kept = [], [], [], []
            for text, runs in zip(part.column(1), part.column(2).to_pylist()):
                ws = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n.append(len(ws))
                if runs:
                    cover = np.zeros(len(ws) + 1, np.int64)
                    for r in runs:
                        cover[r["a"]] += 1
                        cover[r["b"] + k - 1] -= 1
                    live = np.cumsum(cover[:-1]) == 0
                    ws = [x for x, on in zip(ws, live.tolist()) if on]
                gone.append(n[-1] - len(ws))
                joined = b" ".join(ws)
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "surrogatepass") if with_text else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def repeated_runs(docs: DataFrame, k: int = 13, m: int = 3) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, row, text)`` and ``runs(row, a, b)``: windows ``a`` to ``b - 1`` of that row also start in a smaller
    document. ``row`` is ``xxhash64(doc_id, text)``."""
    spark = docs.sparkSession
    store = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    known = docs.filter("doc_id is not null and text is not null")
    stats = known.select("doc_id", "text").mapInArrow(_stats(k, m), "v long, lo long, hi long, n long").groupBy("v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    shared = store.put("shared", stats.filter("lo < hi").select("v", "n"))
    hot = np.array([r.v for r in shared.filter(F.col("n") > HOT).orderBy(F.desc("n"), "v").limit(HOT_KEYS).collect()], np.int64).view(np.uint64)
    bits = bit_filter(shared.select(F.col("v").alias("h")), BITS)
    share = spark.sparkContext.broadcast
    share_bits, share_hot = share(bits), share(hot)

    def sent(alone: bool) -> DataFrame:
        return known.mapInArrow(_send(k, m, share_bits, share_hot, alone), "v long, doc long, row long, start int, words string")

    runs = sent(False).repartition("v").sortWithinPartitions("v").mapInArrow(_buckets(k), "row long, a int, b int")
    if len(hot):
        alone = store.put("alone", sent(True).select("doc", "row", "start", "words"))
        low = alone.groupBy("words").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("words", "low")
        runs = runs.unionByName(alone.join(low, "words").filter("low < doc").select("row", F.col("start").alias("a"), (F.col("start") + 1).alias("b")))
    return docs, store.put("runs", runs)


def dedup_substrings(docs: DataFrame, k: int = 13, m: int = 3, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row: ``kept`` has the words outside repeated windows."""
    docs, runs = repeated_runs(docs, k, m)
    lists = runs.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    # texts without a run stay where they are
    plain, some = split(docs, F.col("row"), runs.select("row").distinct())
    kind = lists.schema["runs"].dataType
    every = plain.select("doc_id", "text", F.lit(None).cast(kind).alias("runs")).unionByName(some.join(lists, "row", "left").select("doc_id", "text", "runs"))
    return every.mapInArrow(_strip(k, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
