"""Quality rules: an isolation forest on rule statistics.

One scan gives each document's statistics. Trees split a small subsample of them at random; documents that few splits set
apart have short path lengths and are anomalous. The score from which a document is rejected is calibrated on the labelled
rows that pass the base rules: the lowest one at or above which at most ``MAX_LOST`` of the good rows lie (of a histogram
of scores). Repeated lines and windows are judged by the base rules alone: as features of the forest they were measured to
cost more than they bring (on sf0.1, calibrated on one half of the labels, the other half's bad rows caught fall from 0.86
to 0.26 at the same bound on lost good ones, since many good texts repeat a line).

The forest is fitted on about ``FIT_ROWS`` documents, those with the smallest hashes of their ids (a documented bound); all
documents are scored and all labelled rows that pass the base rules take part in the calibration. Without labels of both
kinds the score 0.6 holds. Equal hashes are in order of the statistics, equal scores share a bin. A very long text is
measured as a chunk of its own.

Null or empty text: all statistics 0, and ``base_failed``. Rows with a null ``doc_id`` are scored like others and have no
label. Repeated rows each come back. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import Scratch

FIT_ROWS = 8192
TREES = 300
SUBSAMPLE = 256
MAX_LOST = 0.005  # of the good labelled rows
BINS = 1000
REPEAT = 8  # words of a window that may repeat within a text
CHUNK = 1 << 19  # bytes of text measured at a time

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_twins", "n_upper", "n_marks"]


def _table(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _table(b"#*$%&|<>")
UPPER = _table(range(0x41, 0x5B))
MARK = _table(x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x not in b"#*$%&|<>")
POINT = _table(x for x in range(256) if x & 0xC0 != 0x80)


def _firsts(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by owner and hash, and where in it a new pair begins."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    return order, new


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of every row of a text column."""
    w = T.words(col)
    n = len(w.offs) - 1
    inside = T.SPACE[w.buf]

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask)][w.offs])

    out = {"n_words": np.diff(w.rows), "word_chars": per_row(inside & POINT[w.buf]), "n_symbols": per_row(SYMBOL[w.buf])}
    newline = np.flatnonzero(w.buf == 10)
    row = np.r_[np.arange(n), np.searchsorted(w.offs, newline, "right") - 1]
    start = np.r_[w.offs[:-1], newline + 1]
    nxt = np.r_[newline, len(w.buf)][np.searchsorted(newline, start)]
    end = np.minimum(nxt, w.offs[1:][row])
    filled = np.r_[0, np.cumsum(inside)]
    full = filled[end] > filled[start]
    row, start, end = row[full], start[full], end[full]
    _, new = _firsts(row, T.span_hash(w.buf, start, end))
    out["n_dup_lines"] = np.bincount(np.sort(row), weights=~new, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    h, owner = w.hashes(), w.owner
    s = T.shingles(h, REPEAT)
    at = np.flatnonzero(np.arange(len(s)) + REPEAT <= np.repeat(w.rows[1:], np.diff(w.rows))[: len(s)])
    order, new = _firsts(owner[at], s[at])
    twice = ~new
    twice[:-1] |= ~new[1:]
    cover = np.zeros(len(h) + 1, np.int64)
    hit = at[order[twice]]
    cover[hit] += 1  # places are distinct
    np.subtract.at(cover, hit + REPEAT, 1)
    out["n_repeat_words"] = np.bincount(owner, weights=np.cumsum(cover[:-1]) > 0, minlength=n).astype(np.int64)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out["n_twins"] = np.bincount(owner, weights=twin, minlength=n).astype(np.int64)
    out |= {"n_upper": per_row(UPPER[w.buf]), "n_marks": per_row(MARK[w.buf])}
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Shares of symbols, of other marks and of capitals among characters, and of words that repeat the one before.

    The pseudo-counts keep short texts, whose shares vary most, from looking odd.
    """
    words, chars = s["n_words"], s["word_chars"]
    return np.stack([s["n_symbols"] / (chars + 50), s["n_marks"] / (chars + 50), s["n_upper"] / (chars + 50), s["n_twins"] / (words + 30)], 1)


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), limit, left child, path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sub: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.norm = [], _path(min(sub, len(x)))
        deep = max(1, int(np.ceil(np.log2(max(2, min(sub, len(x)))))))
        for _ in range(trees):
            nodes: list[list] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, x[rng.permutation(len(x))[:sub]], 0)]
            while todo:
                at, part, depth = todo.pop()
                wide = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and depth < deep else []
                if not len(wide):
                    nodes[at] = [-1, 0.0, 0, depth + _path(len(part))]
                    continue
                f = int(rng.choice(wide))
                limit = rng.uniform(part[:, f].min(), part[:, f].max())
                low = part[:, f] < limit
                nodes[at] = [f, limit, len(nodes), 0.0]
                todo += [(len(nodes), part[low], depth + 1), (len(nodes) + 1, part[~low], depth + 1)]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            f, limit, child, path = map(np.array, zip(*nodes))
            self.trees.append((f.astype(np.int64), limit, child.astype(np.int64), path))
        self.deep = deep

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, limit, child, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.deep):
                k = f[at]
                at = np.where(k < 0, at, child[at] + (x[rows, k] >= limit[at]))
            total += path[at]
        return 2 ** (-total / max(1, len(self.trees)) / max(self.norm, 1e-9))


def _measured(batches):
    for part in T.chunks(batches, most=CHUNK):
        s = measure(part.column(1))
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s[c].astype(np.int64)) for c in BASE + MORE)], ["doc_id", *BASE, *MORE])


def _scored(forest):
    def run(batches):
        for part in batches:
            s = {c: part.column(c).to_numpy() for c in BASE + MORE}
            score = forest.value.score(features(s)) if forest.value else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ["doc_id", *BASE]), pa.array(score)], ["doc_id", *BASE, "score"])

    return run


def threshold(bad: np.ndarray, good: np.ndarray) -> float:
    """The score to reject from, given histograms of the scores of bad and good rows over [0, 1]."""
    if not bad.sum() or not good.sum():
        return 0.6
    caught, lost = (np.r_[np.cumsum(x[::-1])[::-1] / x.sum(), 0.0] for x in (bad, good))
    least = int(np.flatnonzero(lost <= MAX_LOST)[0])
    # between bins without a bad row the highest will do as well
    return int(np.flatnonzero(caught == caught[least])[-1]) / BINS if caught[least] else 1.1


def _fitted(docs: DataFrame, labels: DataFrame | None):
    """Scored statistics of every row, the forest (broadcast) and the score to reject from."""
    spark = docs.sparkSession
    store = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = store.put("stats", docs.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)))
    live = stats.filter("n_words > 0")
    # hashes below a limit that leaves some more than FIT_ROWS, so that no task sends FIT_ROWS of its own
    share = min(1.0, 1.25 * FIT_ROWS / max(1, live.count()))
    h = F.pmod(F.xxhash64(*(F.col(c) for c in ["doc_id", *BASE, *MORE])), F.lit(1 << 30))
    fit = live.filter(h < int(share * (1 << 30)) + 1).orderBy(h, "doc_id", *BASE, *MORE).limit(FIT_ROWS).toPandas()
    forest = spark.sparkContext.broadcast(Forest(features({c: fit[c].to_numpy() for c in BASE + MORE})) if len(fit) else None)
    scored = store.put("scored", stats.mapInArrow(_scored(forest), "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double"))
    limit = 0.6
    if labels is not None:
        known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"))
        hist = scored.filter("doc_id is not null and n_words >= 20 and 100 * n_repeat_words <= 30 * n_words").join(known, "doc_id").groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), (F.col("q") > 0).alias("good")).count().collect()
        bad, good = np.zeros(BINS), np.zeros(BINS)
        for r in hist:
            (good if r.good else bad)[r.bin] += r["count"]
        limit = threshold(bad, good)
    return scored, forest, limit


def rule_verdicts(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``kept`` and the anomaly ``score`` of every row of ``docs``."""
    scored, _, limit = _fitted(docs, labels)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("score") < limit)).alias("kept"), "score")


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns. The rules are applied on the scan, so no text is
    shuffled to meet its verdict."""
    _, forest, limit = _fitted(docs, labels)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        out = []
        for part in T.chunks(iter([pa.RecordBatch.from_arrays([text], ["text"])]), most=CHUNK):
            s = measure(part.column(0))
            failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
            out.append(~failed & (forest.value.score(features(s)) < limit) if forest.value else ~failed)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(kept(F.col("text").cast("string")))
