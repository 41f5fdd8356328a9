"""Hard negatives by an orthogonal PCA rotation.

All rows are turned so that leading components hold most of their length. Anchors are read in blocks of a fixed number of
bytes; each task holds a block and goes over its own rows in tiles. For a tile the products of the leading components come
first; with the norms of the rest and a slack for rounding they bound the whole product from both sides. Pairs out of bounds
are left, the others get more components, and what remains is verified by the product of whole numbers. No pair is lost: a
pair goes only if it can't enter its list. Lists are merged by anchor; no label and no vector gathers its rows anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Scratch
from ._vectors import packed, unpacked, usable, whole, width

QUERIES = 50  # rows whose id is a multiple are anchors
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive's score between which a hard negative lies
BLOCK = 8 << 20  # bytes of anchors that a task holds
TILE = 1 << 19  # anchors times rows looked at together
STEPS = (1 / 4, 1 / 2)  # shares of the components after which pairs are judged


def prepared(rows: DataFrame, d: int) -> DataFrame:
    """``vec_id, label, q``: rows that take part, labels changed where the id is divisible by 7, vectors as whole numbers.
    Copies of a row count once."""
    rows = usable(rows.select("vec_id", "label", "embedding")).filter("vec_id is not null and label is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed(whole(b.column(2), d))], ["vec_id", "label", "q"])

    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding").mapInArrow(run, "vec_id long, label long, q binary")
    return out.distinct()


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the second moments, largest first; ``d * d`` sums come to the driver, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = unpacked(b.column(0), d).astype(np.float64)
            total += x.T @ x
        i, j = np.indices((d, d)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    m = np.zeros((d, d))
    for i, j, s in rows.select("q").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        m[i, j] = s
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


class Turned:
    """Vectors of a tile or a block: whole numbers, turned ones, and the norm of what follows each step."""

    def __init__(self, q: np.ndarray, turn: np.ndarray):
        self.q = q
        self.x = q @ turn
        d = q.shape[1]
        self.cuts = sorted({max(1, int(d * s)) for s in STEPS} | {d})
        self.rest = [np.sqrt((self.x[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
        # a turned component is off by d ulp of the length at most, the d of them together and a product of two by some d**1.5
        self.slack = np.sqrt((self.x**2).sum(axis=1)) * np.sqrt(16 * (d + 8) ** 1.5 * np.finfo(np.float64).eps)


def survivors(a: Turned, b: Turned, allowed: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` of the ``allowed`` pairs whose product may lie from ``low[i]`` to ``high[i]``, inclusively.

    The first step is a product of matrices; later ones add components for the pairs that are left.
    """
    at = a.cuts[0]
    part = a.x[:, :at] @ b.x[:, :at].T
    spare = np.outer(a.rest[0], b.rest[0]) + np.outer(a.slack, b.slack) + 1e-6
    keep = allowed & (part + spare >= low[:, None])
    if high is not None:
        keep &= part - spare <= high[:, None]
    i, j = np.nonzero(keep)
    part = part[i, j]
    for k in range(1, len(a.cuts)):
        if not len(i):
            break
        to = a.cuts[k]
        part = part + np.einsum("ij,ij->i", a.x[i, at:to], b.x[j, at:to])
        spare = a.rest[k][i] * b.rest[k][j] + a.slack[i] * b.slack[j] + 1e-6
        keep = part + spare >= low[i]
        if high is not None:
            keep &= part - spare <= high[i]
        i, j, part, at = i[keep], j[keep], part[keep], to
    return i, j


def exact(a: Turned, b: Turned, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of whole numbers."""
    step = max(1, TILE // max(1, a.q.shape[1]))
    out = [np.einsum("ij,ij->i", a.q[i[k : k + step]], b.q[j[k : k + step]]) for k in range(0, len(i), step)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Best:
    """For each of ``n`` lists the first ``k`` by score, then id; copies of an entry stand side by side."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.of = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.last = np.full(n, np.iinfo(np.int64).min)  # the k-th score, or the least number while there are fewer

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(of):
            return
        of, score, ids = (np.concatenate(x) for x in ((self.of, of), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]
        full = place[keep] == self.k - 1
        self.last[self.of[full]] = self.score[full]


def _tiles(batches: Iterator[pa.RecordBatch], d: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), unpacked(part.column(2), d)


def _blocks(spark: SparkSession, anchors: DataFrame, d: int) -> Iterator:
    """Broadcasts of anchors, dealt by a hash so that each block has some ``BLOCK`` bytes at most, about half of that on average
    where there are several; the driver holds one at a time."""
    most = max(1, BLOCK // (8 * max(d, 1) + 16))
    n = anchors.count()
    count = -(-n // most)
    numbered = anchors if count <= 1 else anchors.withColumn("_part", F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(2 * count)))
    for k in range(1 if count <= 1 else 2 * count):
        mine = anchors if count <= 1 else numbered.filter(F.col("_part") == k).drop("_part")
        rows = mine.orderBy("vec_id", "label", "q").collect()
        if rows:
            q = np.frombuffer(b"".join(bytes(r.q) for r in rows), np.int64).reshape(len(rows), d)
            yield spark.sparkContext.broadcast((np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), q))


def _nearest(rows: DataFrame, block, turn, d: int, k: int) -> DataFrame:
    """``a, score, id``: the first ``k`` other rows of the same label of each anchor in the block (``a`` is its place there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q = block.value
        step = max(1, min(len(ids), 1024))
        parts = [(at, Turned(q[at : at + step], turn.value), Best(len(ids[at : at + step]), k)) for at in range(0, len(ids), step)]
        for vid, lab, x in _tiles(batches, d, max(1, TILE // step)):
            tile = Turned(x, turn.value)
            for at, a, best in parts:
                own = labels[at : at + step, None]
                same = (own == lab) & ((ids[at : at + step, None] != vid))
                twins = np.nonzero((own == lab) & (ids[at : at + step, None] == vid))
                for i, j in zip(*twins, strict=True):  # another row with the anchor's id is another row unless its vector is equal too
                    same[i, j] = not np.array_equal(a.q[i], x[j])
                i, j = survivors(a, tile, same, best.last, None)
                score = exact(a, tile, i, j)
                keep = score >= best.last[i]
                best.add(i[keep], score[keep], vid[j[keep]])
        for at, _, best in parts:
            yield pa.RecordBatch.from_arrays([pa.array(best.of + at), pa.array(best.score), pa.array(best.id)], ["a", "score", "id"])

    return _merged(rows.mapInArrow(run, "a long, score long, id long"), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each list; every task sends ``k`` a list at most, Spark keeps the first again before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _between(rows: DataFrame, block, windows, turn, d: int, k: int) -> DataFrame:
    """``a, score, id``: the first ``k`` rows of another label in each window (``a`` is the window's number).

    ``windows``: anchor's place, lowest and highest score of each, ordered by anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q = block.value
        of, low, high = windows.value
        step = max(1, min(len(ids), 1024))
        parts = []
        for at in range(0, len(ids), step):
            first, last = np.searchsorted(of, [at, at + step])
            n = len(ids[at : at + step])
            top = np.full(n, np.iinfo(np.int64).min)
            np.maximum.at(top, of[first:last] - at, high[first:last])
            parts.append((at, first, last, top, Turned(q[at : at + step], turn.value), Best(last - first, k)))
        for vid, lab, x in _tiles(batches, d, max(1, TILE // step)):
            tile = Turned(x, turn.value)
            for at, first, last, top, a, best in parts:
                need = np.maximum(low[first:last], best.last)  # a window's score to beat
                least = np.full(len(top), np.iinfo(np.int64).max)
                np.minimum.at(least, of[first:last] - at, need)
                i, j = survivors(a, tile, labels[at : at + step, None] != lab, least, top)
                score = exact(a, tile, i, j)
                keep = (score >= least[i]) & (score <= top[i])
                i, j, score = i[keep], j[keep], score[keep]
                # each pair against the windows of its anchor
                begin = np.searchsorted(of[first:last], i + at)
                count = np.searchsorted(of[first:last], i + at, "right") - begin
                pair = np.repeat(np.arange(len(i)), count)
                w = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
                fits = (score[pair] >= need[w]) & (score[pair] <= high[first:last][w])
                best.add(w[fits], score[pair[fits]], vid[j[pair[fits]]])
        for _, first, _, _, _, best in parts:
            yield pa.RecordBatch.from_arrays([pa.array(best.of + first), pa.array(best.score), pa.array(best.id)], ["a", "score", "id"])

    return _merged(rows.mapInArrow(run, "a long, score long, id long"), k)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame) -> DataFrame:
    """The first ``NEGATIVES`` rows of another label for each anchor and positive of ``rows(vec_id, label, embedding)``.

    Rows without an id, a label or a vector, and rows with a null, NaN or infinite component take no part. Copies of a row
    (equal id, label and components) count once; rows that share an id but not the rest are rows of their own. Vectors of
    different lengths are padded with zeros. Components beyond what 64 bits allow (some 7e5 for 64 of them) are held at that.
    Equal scores go by id. An empty table, or one without anchors, gives no rows; other columns are ignored.

    Of an anchor the driver sees its vector, its positives' scores and nothing else, one block at a time; the results are
    written block by block to one table.
    """
    spark = rows.sparkSession
    store = Scratch(spark)
    d = width(usable(rows.select("embedding")))
    if not d:
        return spark.createDataFrame([], OUT)
    ready = store.put("rows", prepared(rows, d))
    turn = spark.sparkContext.broadcast(rotation(ready, d))
    path, wrote = store.path("found"), False
    for block in _blocks(spark, ready.filter(F.col("vec_id") % QUERIES == 0), d):
        ids = block.value[0]
        near = _nearest(ready, block, turn, d, POSITIVES).orderBy("a", "rank").select("a", "score", "id").toArrow()
        of, p, pid = (near.column(c).to_numpy() for c in ("a", "score", "id"))
        # whole numbers: 100 n >= 50 p and 100 n <= 95 p
        low, high = [-(-LOW * int(x) // 100) for x in p], [HIGH * int(x) // 100 for x in p]
        windows = spark.sparkContext.broadcast((of, np.array(low, np.int64), np.array(high, np.int64)))
        found = _between(ready, block, windows, turn, d, NEGATIVES)
        names = pa.table({"a": pa.array(np.arange(len(of))), "anchor_id": pa.array(ids[of] if len(of) else np.zeros(0, np.int64)), "positive_id": pa.array(pid), "positive_score": pa.array(p)})
        named = found.join(F.broadcast(spark.createDataFrame(names)), "a")  # POSITIVES rows an anchor of the block
        named.selectExpr("anchor_id", "positive_id", "rank", "id as negative_id", "positive_score", "score as negative_score").write.mode("append").parquet(path)
        wrote = True
        block.unpersist()
        windows.unpersist()
    return spark.read.schema(OUT).parquet(path) if wrote else spark.createDataFrame([], OUT)
