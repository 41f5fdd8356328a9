"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

The network reads runs of non-space bytes in both directions and labels every byte; a document's probabilities are the
mean over all its bytes. State is reset between runs, so a run's result depends on its bytes alone: within a chunk each
distinct run is read once, and a table of bounded size keeps the results of earlier ones. It is trained by backpropagation
through time on the driver, on at most ``PER_LANGUAGE`` documents of each language (those with the smallest hashes; fewer
of each where there are more than ``LANGUAGES`` languages, so that their number is bounded), of each a piece of
``FIT_CHARS`` characters at a place that its hash tells, and of that ``FIT_WORDS`` random pieces of runs; documents whose
``crc32(doc_id) mod 5`` is 0 are held out. Prediction covers every byte of every text, however long.

An empty table gives an empty result; equal probabilities go to the first name in order. Null text, or text without a letter: ``und`` with score 1. With nothing to learn from every text is ``und``. A null
``doc_id`` is never held out and never learnt from. Repeated rows each come back; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T

PER_LANGUAGE = 512
LANGUAGES = 256  # with more labels than this, each has fewer documents
FIT_CHARS = 2_000
FIT_WORDS = 200
RUN = 24  # bytes read without a reset
KNOWN = 1 << 18
HIDDEN = 12
STEPS = 500
BATCH = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Gru:
    """Two recurrent layers, one per direction; weights are float32. Gates are stacked: update, reset, candidate."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w["e" + d] = rng.normal(0, 0.3, (257, 3 * hidden))  # byte 256 pads
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        self.w["o"] = rng.normal(0, 0.1, (2 * hidden, classes))
        self.w["c"] = np.zeros(classes)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _states(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        h = self.h
        out = np.zeros((x.shape[1], len(x), h), np.float32)
        s = np.zeros((len(x), h), np.float32)
        e, u = self.w["e" + d], self.w["u" + d]
        for t in range(x.shape[1]) if d == "f" else reversed(range(x.shape[1])):
            a = e[x[:, t]]
            g = s @ u[:, : 2 * h]
            g += a[:, : 2 * h]
            zr = _sigmoid(g)
            z, r = zr[:, :h], zr[:, h:]
            rs = r * s
            n = np.tanh(a[:, 2 * h :] + rs @ u[:, 2 * h :])
            m = live[:, t : t + 1] * z
            if keep is not None:
                keep.append((t, s, z, r, n, rs))
            s = s + m * (n - s)
            out[t] = s
        return out

    def forward(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities of each class at each byte: (time, rows, classes)."""
        both = np.concatenate([self._states(x, live, "f"), self._states(x, live, "b")], 2)
        p = np.exp(both @ self.w["o"] + self.w["c"])
        return p / p.sum(2, keepdims=True)

    def step(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over the live bytes."""
        h, w = self.h, self.w
        tapes = {d: [] for d in "fb"}
        both = np.concatenate([self._states(x, live, d, tapes[d]) for d in "fb"], 2)
        p = np.exp(both @ w["o"] + w["c"])
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(x)), y] -= 1
        p *= (live.T / live.sum())[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["o"] = np.einsum("tnh,tnc->hc", both, p)
        grad["c"] = p.sum((0, 1))
        back = p @ w["o"].T
        for i, d in enumerate("fb"):
            u, ds = w["u" + d], np.zeros((len(x), h), np.float32)
            for t, s, z, r, n, rs in reversed(tapes[d]):
                ds = ds + back[t, :, i * h : i * h + h]
                on = live[:, t : t + 1]
                dz = ds * on * (n - s) * z * (1 - z)
                dn = ds * on * z * (1 - n * n)
                drs = dn @ u[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                np.add.at(grad["e" + d], x[:, t], da)
                grad["u" + d][:, : 2 * h] += s.T @ da[:, : 2 * h]
                grad["u" + d][:, 2 * h :] += rs.T @ dn
                ds = ds * (1 - on * z) + drs * r + da[:, : 2 * h] @ u[:, : 2 * h].T
        return grad


def runs(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte limits of pieces of at most ``RUN`` bytes of the words."""
    n = -(-(w.ends - w.starts) // RUN)
    each = np.repeat(np.arange(len(n)), n)
    a = w.starts[each] + RUN * (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
    return a, np.minimum(a + RUN, w.ends[each])


def padded(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = a[:, None] + np.arange(int((b - a).max()))
    live = at < b[:, None]
    return np.where(live, buf[np.minimum(at, len(buf) - 1)], 256).astype(np.int64), live.astype(np.float32)


def train(texts: list[str], labels: list[int], classes: int, seed: int = 5) -> Gru:
    rng = np.random.default_rng(seed)
    w = T.words(pa.array(texts, pa.string()))
    pick, y = [], []
    first, last = runs(w)
    row = np.searchsorted(w.offs, np.r_[first, len(w.buf)], "right") - 1
    edge = np.searchsorted(row[:-1], np.arange(len(w.offs)))
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        got = np.arange(a, b) if b - a <= FIT_WORDS else rng.choice(np.arange(a, b), FIT_WORDS, False)
        pick.append(got)
        y.append(np.full(len(got), labels[i]))
    pick, y = np.concatenate(pick), np.concatenate(y)
    if not len(pick):
        return Gru(classes)
    a, b = first[pick], last[pick]
    by = [np.flatnonzero(y == c) for c in range(classes)]  # languages take turns, however common
    by = [x for x in by if len(x)]
    net = Gru(classes)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for i in range(1, STEPS + 1):
        rows = np.concatenate([x[rng.integers(0, len(x), max(1, BATCH // len(by)))] for x in by])
        x, live = padded(w.buf, a[rows], b[rows])
        rate = 0.02 * min(1, 2 * (1 - i / (STEPS + 1)))
        for k, g in net.step(x, live, y[rows]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    return net


class Reader:
    """Sums of a run's byte probabilities, by the hash of the run."""

    def __init__(self, net: Gru):
        self.net = net
        self.h = np.zeros(0, np.uint64)
        self.p = np.zeros((0, net.w["c"].shape[0]), np.float32)

    def read(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), self.p.shape[1]), np.float32)
        order = np.argsort(b - a, kind="stable")
        for i in range(0, len(order), 4096):
            k = order[i : i + 4096]
            x, live = padded(buf, a[k], b[k])
            out[k] = (self.net.forward(x, live) * live.T[:, :, None]).sum(0)
        return out

    def sums(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h, first, back = np.unique(T.span_hash(buf, a, b), return_index=True, return_inverse=True)
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        old = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        p = np.empty((len(h), self.p.shape[1]), np.float32)
        p[old] = self.p[at[old]]
        p[~old] = self.read(buf, a[first[~old]], b[first[~old]])
        room = KNOWN - len(self.h)
        if room > 0 and not old.all():
            new = np.flatnonzero(~old)[:room]
            every = np.r_[self.h, h[new]]
            order = np.argsort(every, kind="stable")
            self.h, self.p = every[order], np.concatenate([self.p, p[new]])[order]
        return p[back]


def _predict(net, names: list[str]):
    def run(batches):
        reader = Reader(net.value) if names else None
        for part in T.chunks(batches, most=4 * T.CHUNK):
            n = part.num_rows
            letter = pc.fill_null(pc.match_substring_regex(part.column(2), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            name, score = np.full(n, "und", object), np.ones(n)
            if names:
                w = T.words(part.column(2))
                a, b = runs(w)
                total = np.zeros((n, len(names)))
                if len(a):
                    p, row = reader.sums(w.buf, a, b), np.searchsorted(w.offs, a, "right") - 1
                    for c in range(len(names)):
                        total[:, c] = np.bincount(row, p[:, c], n)
                best = total.argmax(1)
                name[letter] = np.array(names, object)[best[letter]]
                score[letter] = np.clip(total.max(1) / np.maximum(total.sum(1), 1e-9), 0, 1)[letter]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id, mod: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0) & (F.length("text") > 0))
    many = known.select(F.count_distinct("lang")).first()[0]
    per = max(64, PER_LANGUAGE * LANGUAGES // max(LANGUAGES, many) // 64 * 64)
    salted = Window.partitionBy("lang", F.pmod(F.col("h"), F.lit(64))).orderBy("h", "doc_id")
    ids = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(17)).alias("h")).withColumn("i", F.row_number().over(salted)).filter(F.col("i") <= per // 64).select("doc_id", "lang")
    place = F.pmod(F.xxhash64("doc_id", F.lit(18)), F.greatest(F.length("text") - FIT_CHARS, F.lit(1))) + 1
    piece = F.substr("text", place, F.lit(FIT_CHARS)).alias("text")
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", piece).collect()  # ``per`` of each language, of 2000 characters
    names = sorted({r.lang for r in rows})
    rows = sorted((names.index(r.lang), r.text) for r in rows)
    net = train([t for _, t in rows], [y for y, _ in rows], len(names)) if rows else None
    return docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text").mapInArrow(_predict(spark.sparkContext.broadcast(net), names), "doc_id long, held_out boolean, lang_pred string, score double")
