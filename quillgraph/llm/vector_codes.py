"""Codes of vector parts by annular norm pruning.

The entries of a part's codebook are sorted by norm. The entry whose norm is closest gives a first distance; no entry whose
norm differs by more than that can be nearer, so binary search gives the interval of norms (an annulus) that is left, limits
included, and only its entries are evaluated, in whole numbers. Rows never move: each round every task adds up what its rows
give to the entries, and sums of a fixed number come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._vectors import packed, unpacked, usable, whole, width

PARTS = 16
ENTRIES = 64
ROUNDS = 2
TILE = 1 << 14  # parts looked at together
LABELS = 1 << 16  # sums by label are broadcast up to this number of labels, a few MB; beyond, they are joined in salted parts
SALTS = 32
OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` to each row of ``x`` and the squared distance; ties go to the lower index."""
    norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms, entries = norms[order], entries[order]
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for k in range(0, len(x), TILE):
        index[k : k + TILE], error[k : k + TILE] = _annulus(x[k : k + TILE], entries, norms, order)
    return index, error


def _annulus(x: np.ndarray, entries: np.ndarray, norms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mine = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    above = np.minimum(np.searchsorted(norms, mine), len(norms) - 1)
    best = np.minimum(*(((x - entries[e]) ** 2).sum(axis=1) for e in (above, np.maximum(above - 1, 0))))
    reach = np.sqrt(best.astype(np.float64)) + (mine + norms[-1] + 1) * 1e-12  # limits are included, whatever roots are rounded to
    low, high = np.searchsorted(norms, mine - reach), np.searchsorted(norms, mine + reach, "right")
    count = high - low
    begin = np.cumsum(count) - count
    row = np.repeat(np.arange(len(x)), count)
    at = np.arange(len(row)) - np.repeat(begin - low, count)
    far = ((x[row] - entries[at]) ** 2).sum(axis=1)
    error = np.minimum.reduceat(far, begin)
    index = np.minimum.reduceat(np.where(far == error[row], order[at], len(order)), begin)
    return index, error


def _parts(q: np.ndarray) -> np.ndarray:
    return q.reshape(len(q), PARTS, q.shape[1] // PARTS)


def _round(rows: DataFrame, books: np.ndarray, d: int) -> np.ndarray:
    """Codebooks after one round: each entry the floor of its parts' mean, unused ones as they were."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(held.value.shape, np.int64)
        n = np.zeros(held.value.shape[:2], np.int64)
        for b in batches:
            x = _parts(unpacked(b.column(0), d))
            for p in range(PARTS):
                index, _ = nearest(x[:, p], held.value[p])
                np.add.at(total[p], index, x[:, p])
                n[p] += np.bincount(index, minlength=n.shape[1])
        p, e, j = np.nonzero(np.broadcast_to(n[:, :, None], total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (p, e, j, total[p, e, j], n[p, e])], ["p", "e", "j", "s", "n"])

    sums = rows.select("q").mapInArrow(run, "p long, e long, j long, s long, n long").groupBy("p", "e", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    out = books.copy()
    for p, e, j, s, n in sums.collect():  # PARTS * ENTRIES * part width, whatever the number of rows
        out[p, e, j] = int(s) // int(n)
    held.unpersist()
    return out


def codebooks(rows: DataFrame, d: int) -> np.ndarray:
    """Entries by part, of ``rows(vec_id, q)``: the parts of the first ids, moved ``ROUNDS`` times."""
    first = rows.filter("vec_id is not null").select("vec_id", "q").orderBy("vec_id", "q").limit(ENTRIES).collect()
    books = np.frombuffer(b"".join(bytes(r.q) for r in first), np.int64).reshape(len(first), PARTS, d // PARTS).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS if first else 0):
        books = _round(rows, books, d)
    return books


def vector_codes(rows: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row of ``rows(vec_id, label, embedding)`` with a usable vector.

    Rows whose vector is null or has a null, NaN or infinite component are dropped. Repeated rows count each; a row without an
    id is coded but founds no entry, equal ids found entries in the order of their bytes; fewer than ``ENTRIES`` rows make a
    smaller codebook, and without any id to found one all codes and errors are null. Vectors of
    other lengths are padded with zeros to the longest, and that to a multiple of ``PARTS``. Components beyond what 64 bits
    allow are held at that. Null labels are one label. An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    store = Scratch(spark)
    kept = usable(rows.select("vec_id", "label", "embedding"))
    d = -(-width(kept) // PARTS) * PARTS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(whole(b.column(2), d))], ["vec_id", "label", "q"])

    if not d:
        return spark.createDataFrame([], OUT)
    longs = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    ready = store.put("rows", longs.mapInArrow(pack, "vec_id long, label long, q binary"))
    books = codebooks(ready, d)
    if not books.shape[1]:
        none = lambda kind: F.lit(None).cast(kind)
        return ready.select("vec_id", none("string").alias("code"), none("long").alias("error"), none("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    held = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexa = np.frombuffer("".join(f"{i:02x}" for i in range(ENTRIES)).encode(), np.uint8).reshape(ENTRIES, 2)
        for b in batches:
            x = _parts(unpacked(b.column(2), d))
            found = [nearest(x[:, p], held.value[p]) for p in range(PARTS)]
            text = np.concatenate([hexa[i] for i, _ in found], axis=1)
            codes = pa.Array.from_buffers(pa.binary(2 * PARTS), len(x), [None, pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    coded = store.put("codes", ready.mapInArrow(code, "vec_id long, label long, code string, error long"))
    sums = store.put("sums", coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = coded.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)) == F.col("_salt")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
