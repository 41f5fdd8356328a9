"""LM scoring by online logistic context mixing.

A token is coded as bits: a word seen twice or more by a Huffman code over the training counts, others by an escape and
the Huffman codes of their bytes. Only the ``LOOKUP`` most frequent words have a code word of mixed bits; the rest of those
seen twice or more follow the escape, and each costs what its count tells. Each of a code's first ``DEPTH`` bits is
predicted from three hashed contexts: the place in the code alone, with the word before, and with the last very frequent
word; in a spelt word, alone, with the two and with the
three bytes before. Deeper bits, which only tell rare
words apart, cost what the counts tell. Which contexts have been seen selects the set of weights that combines the
predictions in the logistic domain, and the weights are refined after every bit by the coding error. Refinement starts
afresh every ``SEGMENT`` bits, which lets all segments of a chunk run side by side.

All bits of a token in one context are one request: the context's hash, the token's code and how often the chunk has it
in training documents. Each chunk of documents sends its distinct requests to buckets by hash; there the requests of all
chunks are in order of context and code, so the zeros and ones at every place of a code are sums over neighbours, and go
back as one prediction a bit. What follows a very frequent word makes ``TOPIC`` tables of one size, which are broadcast. The number of buckets follows the counted tokens: nothing is of fixed size, no context is
dropped. The contexts of words above ``HOT`` counts are cut after ``TOP`` bits, so none of them sends a bucket more than
``2**TOP`` requests a chunk. Words beyond the lookup learn their exact counts for the base score in the same way.

Null text is empty: its one token is the end. Rows with a null ``doc_id`` are scored, not held out and not learnt from.
Repeated rows count as often as they stand, and each comes back; equal counts are in order of the word's hash. A text above
``CHUNK`` bytes is a chunk of its own. Other columns are ignored; with nothing to learn from, all bits have even odds; an
empty table gives an empty result. Words are told apart by 64-bit hashes. ``docs`` is read four times and must have the
same rows in the same partitions each time, as a table has; a chunk whose answers don't fit raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import Scratch

LOOKUP = 1 << 19
DEPTH = 16
TOP = 8
HOT = 1 << 12  # counts from which a word's context is cut in two
ORDERS = 3
PLACES, BIT = (0, 2, 3), 1  # where a bit's predictions and the bit itself are within four bytes
REST = 32  # bits of a context's hash within its bucket; the lowest two tell the kind
DEAL = 1 << 21  # tokens for each bucket of contexts
LEAST = 64  # buckets
TOPIC = 64
MERGE = 1 << 20  # words whose counts a task holds
SEGMENT = 1024
BLOCK = 1 << 12  # tokens whose bits are laid out at a time
STEPS = 16  # steps of all segments whose inputs are laid out at a time
CHUNK = 1 << 21  # bytes of text whose bits are in memory at a time
SEEN = 0.1  # zeros and ones that are taken for seen beforehand
SCALE = 8.0  # steps of a stored prediction per unit of log odds
ROOT = 3.0
RATE = 0.03
PACK = 5  # zstd level of the texts that travel
SURE = 20  # steps from which a prediction counts as sure
# First weights of the three predictions, by whether the third and the second are missing, unsure or sure.
START = np.array([[1, 0, 0], [0.6, 0.5, 0], [0.4, 0.7, 0], [0.6, 0, 0.5], [0.4, 0.4, 0.4], [0.1, 0.6, 0.5], [0.4, 0, 0.7], [0.2, 0.5, 0.5], [0.1, 0.5, 0.6]], np.float32)
FULL, HEAD, TAIL, BYTE = range(4)  # kinds of requests: which bits of a code they ask for
FROM, TO = np.array([0, 0, TOP, 0]), np.array([DEPTH, TOP, DEPTH, DEPTH])
END = np.uint64(0x9D3A1C64F2B5E871)


def lengths(v: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bits of the code words ``v`` (left-aligned, ``DEPTH`` bits): a canonical code tells by where longer ones begin."""
    return np.searchsorted(limits, v, "right")


def limits(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The smallest left-aligned code word of at least 1, 2, ... ``DEPTH`` bits."""
    v, n = aligned(code, size)
    return np.array([v[n >= k].min() if (n >= k).any() else 1 << DEPTH for k in range(1, DEPTH + 1)])


def aligned(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``DEPTH`` bits of code words, left-aligned, and how many they are."""
    return np.where(size > DEPTH, code >> np.maximum(size - DEPTH, 0), code << np.maximum(DEPTH - size, 0)), np.minimum(size, DEPTH)


@dataclass
class Code:
    """Words by sorted hash with their counts and ranks; for each rank, escape and end: left-aligned code, its length and
    the cost of the bits below ``DEPTH``; code and length of each byte. Predictions for a one are by node, which is a 1
    before the bits that lead to it."""

    h: np.ndarray
    count: np.ndarray
    rank: np.ndarray
    v: np.ndarray
    size: np.ndarray
    rest: np.ndarray
    alone: np.ndarray  # by node
    byte: np.ndarray
    byte_size: np.ndarray
    byte_alone: np.ndarray  # by node
    limits: list[np.ndarray]  # by kind
    topics: np.ndarray | None = None  # by topic and node

    @property
    def escape(self) -> int:
        return len(self.v) - 2

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        order = np.argsort(h)  # sorted lookups stay in cache
        at = np.empty(len(h), np.int64)
        at[order] = np.searchsorted(self.h, h[order])
        at[at == len(self.h)] = 0
        return at, self.h[at] == h


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code words and their lengths, by two queues: leaves in order of weight, and sums in the order they arise."""
    n = len(weights)
    weights = np.maximum(np.asarray(weights, np.int64), 1)
    order = np.argsort(weights, kind="stable")
    leaf, sums = weights[order].tolist(), []
    parent = np.zeros(2 * n, np.int64)
    i = j = 0
    for top in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if j == len(sums) or i < n and leaf[i] <= sums[j]:
                total += leaf[i]
                parent[i] = top
                i += 1
            else:
                total += sums[j]
                parent[n + j] = top
                j += 1
        sums.append(total)
    depth = np.zeros(2 * n, np.int64)
    up = parent.tolist()
    deep = [0] * (2 * n)
    for k in range(2 * n - 3, -1, -1):
        deep[k] = deep[up[k]] + 1
    depth[order] = deep[:n]
    size = np.maximum(depth[:n], 1)
    # canonical: equal lengths count up, a longer one goes on from the next shorter one
    by = np.argsort(size, kind="stable")
    first, value, last = {}, 0, 0
    lens, counts = np.unique(size, return_counts=True)
    for k, c in zip(lens.tolist(), counts.tolist()):
        value <<= k - last
        first[k], last = value, k
        value += c
    code = np.empty(n, np.int64)
    code[by] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat([first[k] for k in lens.tolist()], counts)
    return code, size


def make_code(h: np.ndarray, count: np.ndarray, total: int, ends: int, bytes_seen: np.ndarray) -> Code:
    order = np.lexsort((h, -count))
    h, count = h[order], count[order]
    own = int((count >= 2).sum())
    weights = np.r_[count[:own], max(1, total - ends - int(count[:own].sum())), max(1, ends)]
    code, size = huffman(weights.tolist())
    v, n = aligned(code, size)
    _, group = np.unique(v, return_inverse=True)  # words that share their first bits
    rest = np.log2(np.bincount(group, weights)[group] / weights)
    rest[size <= DEPTH] = 0
    alone = tree(np.bincount(v, weights, 1 << DEPTH)[None])[0]
    weights = bytes_seen + 1 + int(bytes_seen.sum() >> 9)  # a floor keeps all within DEPTH
    byte, byte_size = huffman(weights.tolist())
    assert byte_size.max() <= DEPTH
    word, spelt = limits(code, size), limits(byte, byte_size)
    byte = aligned(byte, byte_size)[0]
    byte_alone = tree(np.bincount(byte, weights, 1 << DEPTH)[None])[0]
    by = np.argsort(h, kind="stable")
    return Code(h[by], count[by], np.arange(len(h))[by], v, n, rest, alone, byte, byte_size, byte_alone, [word, word, word, spelt])


def predictions(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds of a one in steps of ``1 / SCALE``; 0 only where nothing was seen."""
    p = np.log((n1 + SEEN).astype(np.float32) / (n0 + SEEN).astype(np.float32)) * np.float32(SCALE)
    q = np.clip(np.rint(p), -127, 127).astype(np.int8)
    q[(q == 0) & (n0 + n1 > 0)] = 1
    return q


def tree(n: np.ndarray) -> np.ndarray:
    """Predictions for a one at every node, from the counts of the ``2**DEPTH`` left-aligned code words (one row each)."""
    out = np.zeros((len(n), 1 << DEPTH), np.int8)
    for j in reversed(range(DEPTH)):
        out[:, 1 << j : 2 << j] = predictions(n[:, ::2], n[:, 1::2])
        n = n[:, ::2] + n[:, 1::2]
    return out


def nodes(v: np.ndarray) -> np.ndarray:
    """The nodes on the way of each code word."""
    j = np.arange(DEPTH, dtype=np.int32)
    return (np.int32(1) << j) | (v.astype(np.int32)[:, None] >> (DEPTH - j))


def bit_rows(v: np.ndarray) -> np.ndarray:
    """The bits of each code word."""
    return np.unpackbits(v.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)


# Predictions travel as their roots, which are fine where a bit is open and coarse where it is sure.
_WIDE = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.float64) / SCALE
SHORT = (np.sign(_WIDE) * np.maximum(np.rint(ROOT * np.sqrt(np.abs(_WIDE))), _WIDE != 0)).astype(np.int8)
LONG = (np.sign(_WIDE) * np.clip(np.rint((_WIDE * SCALE / ROOT) ** 2 * SCALE), _WIDE != 0, 127)).astype(np.int8)


def towards(key: np.ndarray, v: np.ndarray, n: np.ndarray, size: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | int = DEPTH) -> np.ndarray:
    """For rows in order of key and code word, seen ``n`` times: the prediction at each bit (``low`` to ``high``) of the
    word, positive where it is for the word's own bit."""
    last = np.minimum(size, high)
    place = np.arange(DEPTH)
    live = (place >= np.reshape(low, (-1, 1))) & (place < last[:, None])
    new = np.r_[True, key[1:] != key[:-1]][: len(v)]
    # a context with one code word says the same at each bit
    out = predictions(np.zeros(len(n), np.int64), n)[:, None] * live
    some = np.flatnonzero(~(new & np.r_[new[1:], True][: len(v)]))
    new, v, n, live = new[some], v[some], n[some], live[some]
    for j in np.flatnonzero(live.any(0)).tolist():
        head = v >> (DEPTH - j)
        first = np.flatnonzero(new | np.r_[True, head[1:] != head[:-1]][: len(v)])
        bit = (v >> (DEPTH - 1 - j)) & 1
        n1, both = np.add.reduceat(n * bit, first), np.add.reduceat(n, first)
        p = np.repeat(predictions(both - n1, n1), np.diff(np.r_[first, len(v)]))
        out[some, j] = np.where(live[:, j], np.where(bit, p, -p), 0)
    return out


@dataclass
class Stream:
    """Tokens in the order of a text: code word and length; for each order the requests (key, code word) by kind with
    the token that asks."""

    v: np.ndarray
    size: np.ndarray
    token: np.ndarray  # of the chunk
    asks: list[list[tuple[int, np.ndarray, np.ndarray]]]  # by order: kind, key, place in the stream


@dataclass
class Bits:
    """A chunk's words with codes, and the bytes of spelt words."""

    streams: list[Stream]
    sym: np.ndarray
    char: np.ndarray  # bytes of spelt words
    topic: np.ndarray  # the last of the most frequent words before, as a rank; TOPIC at a text's start
    first: np.ndarray  # tokens of each row
    found: np.ndarray  # place of each token in the lookup
    known: np.ndarray
    h: np.ndarray
    n_bytes: np.ndarray


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n``: which of them each unit is of, and its place there."""
    each = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return each, np.arange(len(each), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)


def bits_of(col: pa.Array, code: Code, ask: bool = True) -> Bits:
    """The chunk's bits; without ``ask`` words alone and no requests."""
    w = T.words(col, lower=True)
    n = np.diff(w.rows)
    first = np.r_[0, np.cumsum(n + 1)]
    h = np.full(first[-1], END, np.uint64)
    at = np.arange(len(w.starts)) + w.owner
    h[at] = w.hashes()
    start, end = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    start[at], end[at] = w.starts, w.ends
    is_end = np.ones(len(h), bool)
    is_end[at] = False
    found, known = code.find(h)
    known &= ~is_end
    rank = np.where(known, code.rank[found] if len(code.rank) else 0, len(code.v))
    sym = np.where(is_end, code.escape + 1, np.where(rank < code.escape, rank, code.escape))
    # contexts of words: the one before, the last very frequent one; 0 before a text's start
    seen = np.where(known, code.count[found] if len(code.count) else 0, 0)
    before, hot = np.r_[np.uint64(0), h[:-1]], np.r_[False, seen[:-1] >= HOT]
    opens = first[:-1]
    before[opens], hot[opens] = 0, True
    last = np.maximum.accumulate(np.where(rank < min(TOPIC, code.escape), np.arange(len(h)), -1))
    last = np.r_[-1, last[:-1]]
    topic = np.where(last >= np.repeat(opens, n + 1), rank[last], TOPIC)
    v, size = code.v[sym], code.size[sym]
    if not ask:
        return Bits([Stream(v, size, np.arange(len(h)), [])], sym, sym[:0], topic, first, found, known, h, np.diff(w.offs))
    key = T.mix(before)
    every, deep = np.arange(len(h)), size > TOP
    top = (v >> (DEPTH - TOP)).astype(np.uint64) + np.uint64(1)

    tail = hot & deep
    asks = [[(FULL, key[~hot], every[~hot]), (HEAD, key[hot], every[hot]), (TAIL, T.mix(key[tail] + top[tail]), every[tail])]]
    streams = [Stream(v, size, every, asks)]
    spell = np.flatnonzero((sym == code.escape) & ~is_end)
    long = (end - start)[spell]
    ct, cj = _spread(long + 1)
    char = np.where(cj < long[ct], w.buf[np.minimum(start[spell][ct] + cj, len(w.buf) - 1)], 0x20).astype(np.int64) if len(spell) else np.zeros(0, np.int64)
    c1, c2, c3 = (np.where(cj >= k, np.r_[np.zeros(k, np.int64), char[:-k]][: len(char)], 0) for k in (1, 2, 3))
    ctx = [x.astype(np.uint64) for x in ((c1 << 8) + (c2 << 16) + 1, (c1 << 8) + (c2 << 16) + (c3 << 24) + 2)]
    streams.append(Stream(code.byte[char], code.byte_size[char], spell[ct], [[(BYTE, T.mix(c + np.uint64(1 << 50)), np.arange(len(char)))] for c in ctx]))
    return Bits(streams, sym, char, topic, first, found, known, h, np.diff(w.offs))


def requests(b: Bits, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct requests of a chunk in order: key (bucket and rest) and code word; the place among them of each request as
    asked (by streams, orders and kinds), and the token that asks."""
    keys, v, token = [], [], []
    for s in b.streams:
        for kind, key, at in (x for order in s.asks for x in order):
            key = key >> np.uint64(64 - REST - (buckets.bit_length() - 1))
            keys.append((key & ~np.uint64(3)) | np.uint64(kind))
            # a head's code word ends after TOP bits
            v.append(s.v[at] & -(1 << (DEPTH - TOP)) if kind == HEAD else s.v[at])
            token.append(s.token[at])
    keys, v, token = np.concatenate(keys), np.concatenate(v), np.concatenate(token)
    if REST + buckets.bit_length() - 1 + DEPTH <= 64:
        both = (keys << np.uint64(DEPTH)) | v.astype(np.uint64)
        order = np.argsort(both)
        new = np.r_[True, np.diff(both[order]) > 0][: len(order)]
    else:
        order = np.lexsort((v, keys))
        x, y = keys[order], v[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(order)]
    seat = np.empty(len(order), np.int64)
    seat[order] = np.cumsum(new) - 1
    first = order[new]
    return keys[first], v[first], seat, token


def _pack(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of numbers in planes, which pack better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unpack(b: np.ndarray, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = b[: n * size].reshape(size, n).T
    return out.view("<u8").ravel()


def log_loss(b: Bits, given: list[list[np.ndarray]], rest: np.ndarray) -> list[np.ndarray]:
    """Bits that each token costs as a code and, for those that are spelt, in spelling: the mixture over the predictions
    ``given`` (for a one, by streams and orders; an array, or a
    function of a slice of tokens, which places are in their codes, and the nodes and bits there), refined bit by bit within a
    segment."""
    totals = [rest[b.sym], np.zeros(len(b.h))]
    level = np.abs(np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64))
    level = (level > 0).astype(np.int64) + (level >= SURE)
    slots = (level + 3 * level[:, None]).ravel()  # by the second and the third prediction as one number
    for s, orders, total in zip(b.streams, given, totals):
        if not len(s.v):
            continue
        # a bit's three predictions and itself are one word of four bytes, laid out some tokens at a time to stay in cache
        edge = np.r_[0, np.cumsum(s.size)]
        word = np.zeros((edge[-1] + STEPS, 4), np.int8)
        for a in range(0, len(s.v), BLOCK):
            z = min(a + BLOCK, len(s.v))
            live = np.arange(DEPTH) < s.size[a:z, None]
            to, one = slice(edge[a], edge[z]), bit_rows(s.v[a:z])[live]
            node = nodes(s.v[a:z])[live]
            for k, p in zip(PLACES, orders):
                word[to, k] = p(a, z, live, node, one) if callable(p) else p[a:z][live]
            word[to, BIT] = one
        bit = word[: edge[-1], BIT] != 0
        word = word.view(np.int32).ravel()
        each = edge[:-1]
        # segments are runs of bits of one row; they advance side by side, the longest first
        row_start = edge[np.searchsorted(s.token, b.first)]
        row, j = _spread(-(-np.diff(row_start) // SEGMENT))
        begin = row_start[row] + j.astype(np.int64) * SEGMENT
        size = np.minimum(row_start[row + 1] - begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        edge = np.r_[0, np.cumsum(live)]
        seat = np.arange(len(size)) * len(START)
        weights = [np.tile(w, len(size)) for w in START.T]  # of each prediction, by segment and slot
        p = np.empty(len(word), np.float32)
        runs = np.lib.stride_tricks.sliding_window_view(word, STEPS)  # whole runs of steps move at once
        p_runs = np.lib.stride_tricks.sliding_window_view(p, STEPS, writeable=True)
        rate = np.float32(RATE)
        short = np.empty((3, len(size)), np.float32)
        for i0 in range(0, len(live), STEPS):
            i1 = min(i0 + STEPS, len(live))
            n = int(live[i0])
            w4 = runs[begin[:n] + i0].T[: i1 - i0].copy()
            x8 = w4.view(np.int8).reshape(i1 - i0, n, 4)
            slot = slots.take(w4.view(np.uint16).reshape(i1 - i0, n, 2)[:, :, 1])
            slot += seat[:n]
            y = x8[:, :, BIT] * rate
            x = [x8[:, :, k] * np.float32(1 / SCALE) for k in PLACES]
            done = np.empty((i1 - i0, n), np.float32)
            for i in range(i1 - i0):
                m = int(live[i0 + i])
                g, q, (r, e) = slot[i, :m], done[i, :m], short[:2, :m]
                ws = [w.take(g) for w in weights]
                np.multiply(ws[0], x[0][i, :m], out=q)
                for w, xs in zip(ws[1:], x[1:]):
                    np.multiply(w, xs[i, :m], out=r)
                    q += r
                np.negative(q, out=q)
                np.exp(q, out=q)
                q += 1
                np.reciprocal(q, out=q)
                np.multiply(q, rate, out=e)
                np.subtract(y[i, :m], e, out=e)
                for own, w, xs in zip(weights, ws, x):
                    np.multiply(xs[i, :m], e, out=r)
                    w += r
                    own[g] = w
            m = int(live[i1 - 1])  # segments that go on to the end of these steps
            if i1 - i0 == STEPS:
                p_runs[begin[:m] + i0] = done[:, :m].T
            else:
                m = 0
            here = np.arange(i0, i1) < size[m:n, None]
            p[(begin[m:n, None] + np.arange(i0, i1))[here]] = done[:, m:].T[here]
        p = np.clip(p[: len(bit)], 1 / 4096, 4095 / 4096)
        cost = np.log(np.where(bit, p, 1 - p)) * np.float32(-1 / np.log(2))
        total += np.bincount(s.token, np.add.reduceat(cost, each), len(b.h))
    return totals


def _counted(batches):
    """Counts of words, texts (as the end) and bytes, added up over the chunks of a task as far as ``MERGE`` words go."""
    held, n, seen, rows = [], 0, np.zeros(256, np.int64), 0

    def out():
        h, c = _added(held)
        return pa.RecordBatch.from_arrays([T.long(np.r_[h, END, np.arange(256, dtype=np.uint64)]), pa.array(np.r_[c, rows, seen]), pa.array(np.r_[np.zeros(len(h) + 1, bool), np.ones(256, bool)])], ["h", "c", "byte"])

    for part in T.chunks(batches, "text", T.CHUNK):
        w = T.words(part.column(0), lower=True)
        held.append(np.unique(w.hashes(), return_counts=True))
        n += len(held[-1][0])
        seen += np.bincount(w.buf, minlength=256)
        rows += part.num_rows
        if n > 2 * MERGE:
            held = [_added(held)]
            n = len(held[0][0])
            if n > MERGE:
                yield out()
                held, n, seen, rows = [], 0, np.zeros(256, np.int64), 0
    if rows:
        yield out()


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(zip(*held) if held else ((), ()), (np.uint64, np.int64)))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
    return h[first], np.add.reduceat(c, first).astype(np.int64) if len(first) else c.astype(np.int64)


def _topics(code):
    """How often each code word follows each topic: at most ``(TOPIC + 1) * 2**DEPTH`` sums, of a task as of all."""

    def run(batches):
        n = np.zeros((TOPIC + 1) << DEPTH, np.int64)
        for part in T.chunks(batches, "text", CHUNK):
            b = bits_of(part.column(0), code.value, False)
            n += np.bincount((b.topic << DEPTH) + b.streams[0].v, minlength=len(n))
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 18):
            k = at[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["k", "n"])

    return run


def _grown(t: pa.Table) -> pa.Table:
    n = np.bincount(t.column("k").to_numpy() & ((1 << DEPTH) - 1), t.column("n").to_numpy(), 1 << DEPTH)
    return pa.table([t.column("topic")[:1], pa.array([tree(n[None])[0].tobytes()], pa.binary())], ["topic", "b"])


def _numbered(batches):
    place = TaskContext.get().partitionId() << 32
    for i, part in enumerate(T.chunks(batches, most=CHUNK)):
        yield place + i, part


def _open(b: Bits, code: Code) -> np.ndarray:
    """Words that the lookup lacks."""
    out = ~b.known
    out[b.first[1:] - 1] = False
    return out


def _packed(batches):
    """Each chunk's rows as one value."""
    for chunk, part in _numbered(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACK))) as out:
            out.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "b"])


def _asked(code, buckets: int):
    """For each chunk and bucket what is asked: contexts with code words, and (in buckets from ``buckets`` on) words, with
    their counts among the documents to learn from."""
    low = np.uint64(REST)
    word_low = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        for chunk, part in _numbered(batches):
            b = bits_of(part.column(2), code.value)
            learn = ~part.column(1).to_numpy(zero_copy_only=False) & np.asarray(part.column(0).is_valid())
            learn = np.repeat(learn, np.diff(b.first))
            keys, v, seat, token = requests(b, buckets)
            n = np.bincount(seat, learn[token], len(keys)).astype(np.uint64)
            words, where = np.unique(b.h[_open(b, code.value)], return_inverse=True)
            k = np.bincount(where, learn[_open(b, code.value)], len(words)).astype(np.uint64)
            to, size, blob = [], [], []
            for base, x, shift, width in ((0, keys, low, 4), (buckets, words, word_low, 8)):
                edge = np.searchsorted(x >> shift, np.arange(buckets + 1, dtype=np.uint64))
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    at = slice(edge[i], edge[i + 1])
                    rest = x[at] & ((np.uint64(1) << shift) - np.uint64(1))
                    raw = _pack(np.diff(rest, prepend=np.uint64(0)), width)
                    raw += _pack(v[at], 2) + _pack(n[at], 4) if not base else _pack(k[at], 4)
                    to.append(base + i)
                    size.append(len(rest))
                    blob.append(pa.compress(raw, "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(len(to), chunk)), pa.array(size, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "chunk", "n", "b"])

    return run


def _answered(code, buckets: int):
    """What the chunks asked one bucket for, in their order: predictions towards each bit, or the counts of words."""

    def run(t: pa.Table) -> pa.Table:
        words = t.column(0)[0].as_py() >= buckets
        sizes = t.column(2).to_numpy()
        edge = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
        key, v, n = np.empty(edge[-1], np.uint64), np.zeros(edge[-1], np.int64), np.empty(edge[-1], np.int64)
        wide = 8 if words else 4
        for i, b in enumerate(t.column(3)):
            m, to = int(sizes[i]), slice(edge[i], edge[i + 1])
            raw = np.frombuffer(pa.decompress(b.as_buffer(), m * (wide + (4 if words else 6)), "zstd"), np.uint8)
            key[to] = np.cumsum(_unpack(raw, m, wide), dtype=np.uint64)
            if not words:
                v[to] = _unpack(raw[m * wide :], m, 2)
            n[to] = _unpack(raw[-4 * m :], m, 4)
        if words:
            order = np.argsort(key)
            new = np.r_[True, np.diff(key[order]) > 0][: len(key)]
        else:
            both = (key << np.uint64(DEPTH)) | v.astype(np.uint64)
            order = np.argsort(both)
            new = np.r_[True, np.diff(both[order]) > 0][: len(key)]
            del both
        first = np.flatnonzero(new)
        n = np.add.reduceat(n[order], first)
        seat = np.empty(len(order), np.int32)
        seat[order] = np.cumsum(new) - 1
        if words:
            blob = [pa.compress(_pack(n[seat[x:y]], 5), "zstd", asbytes=True) for x, y in zip(edge, edge[1:])]
        else:
            key, v = key[order[first]], v[order[first]]
            kind = (key & np.uint64(3)).astype(np.int64)
            size = np.where(kind == BYTE, lengths(v, code.value.limits[BYTE]), lengths(v, code.value.limits[FULL]))
            found = towards(key, v, n, size, FROM[kind], TO[kind])
            # differences from bit to bit pack well, the more so as the last prediction goes on
            last = np.minimum(size, TO[kind])
            for j in range(1, DEPTH):
                np.copyto(found[:, j], found[:, j - 1], where=last <= j)
            found = SHORT[found.view(np.uint8)]
            found[:, 1:] -= found[:, :-1].copy()
            blob = [pa.compress(np.ascontiguousarray(found[seat[x:y]].T).tobytes(), "zstd", asbytes=True) for x, y in zip(edge, edge[1:])]
        return pa.table([t.column(0), t.column(1), t.column(2), pa.array(blob, pa.binary())], t.column_names)

    return run


def _scored(code, buckets: int, ends: int, vocabulary: int, total: int, after: int, once: int):
    fields = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "bits", "n_bytes"]

    def run(rows: pa.Table, t: pa.Table) -> pa.Table:
        c = code.value
        (packed,) = rows.column(1).to_pylist()
        part = pa.ipc.open_stream(packed).read_next_batch()
        t = t.take(pa.array(np.argsort(t.column(0).to_numpy())))
        b = bits_of(part.column(2), c)
        keys, _, seat, _ = requests(b, buckets)
        found, counts = np.zeros((len(keys) + 1, DEPTH), np.int8), []
        at = 0
        for to, n, blob in zip(t.column(0).to_pylist(), t.column(2).to_pylist(), t.column(3)):
            if to < buckets:
                found[at : at + n] = np.frombuffer(pa.decompress(blob.as_buffer(), n * DEPTH, "zstd"), np.int8).reshape(DEPTH, n).T
                at += n
            else:
                counts.append(_unpack(np.frombuffer(pa.decompress(blob.as_buffer(), 5 * n, "zstd"), np.uint8), n, 5))
        found = LONG[np.cumsum(found, 1, dtype=np.int8).view(np.uint8)]
        found[:-1][(keys & np.uint64(3)) == HEAD, TOP:] = 0
        open_ = _open(b, c)
        words, where = np.unique(b.h[open_], return_inverse=True)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.uint64)
        if at != len(keys) or len(counts) != len(words):
            raise RuntimeError("the documents changed between two reads: write them to a table first")
        seen = np.where(b.known, c.count[b.found] if len(c.count) else 0, 0).astype(np.float64)
        seen[open_] = counts[where]
        seen[b.first[1:] - 1] = ends
        topics, given, at_ = c.topics.ravel(), [], 0
        for i, s in enumerate(b.streams):
            need = seen[s.token] < 2 if i else slice(None)  # words seen twice are told by their counts, not spelt
            orders = [lambda a, z, live, node, one, t=c.byte_alone if i else c.alone: t.take(node)]
            for asks in s.asks:
                # places among the answers by token: of the head or whole, and of the tail; the last row is empty
                seats = np.full((2, len(s.v)), len(keys), np.int32)
                for kind, key, place in asks:
                    seats[int(kind == TAIL), place] = seat[at_ : at_ + len(key)]
                    at_ += len(key)
                orders.append(lambda a, z, live, node, one, t=seats[:, need]: (found.take(t[0, a:z], 0) + found.take(t[1, a:z], 0))[live] * (2 * one - 1).view(np.int8))
            if not i:
                orders.append(lambda a, z, live, node, one: topics.take(node + np.repeat(b.topic[a:z].astype(np.int32) << DEPTH, live.sum(1))))
            given.append(orders)
            b.streams[i] = Stream(s.v[need], s.size[need], s.token[need], [])
        coded, spelt = log_loss(b, given, c.rest)
        n = part.num_rows
        owner = np.repeat(np.arange(n), np.diff(b.first))
        # after the escape a word is told by its share of the counts, or spelt
        tail = np.where(seen >= 2, np.log2(after / np.maximum(seen, 1)), spelt + np.log2(after / once))
        bits = np.bincount(owner, coded + np.where(open_, tail, spelt), n)
        size = np.diff(b.first)
        base = np.bincount(owner, np.log10(seen + 1), n) - size * np.log10(total + vocabulary + 1)
        return pa.table([part.column(0), part.column(1), pa.array(size), pa.array(np.bincount(owner, seen > 0, n).astype(np.int64)), pa.array(base), pa.array(bits), pa.array(b.n_bytes.astype(np.int64))], fields)

    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row of ``docs``."""
    spark = docs.sparkSession
    store = Scratch(spark)
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learn = docs.filter(F.col("doc_id").isNotNull() & (rest != 2)).select("text")
    counts = store.put("counts", learn.mapInArrow(_counted, "h long, c long, byte boolean").groupBy("byte", "h").agg(F.sum("c").alias("c")))
    bytes_seen = np.zeros(256, np.int64)
    for r in counts.filter("byte").collect():
        bytes_seen[r.h] = r.c
    counts = counts.filter("not byte").select("h", "c")
    end = int(END.view(np.int64))
    n_tokens, n_words, ends = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("h") == end, F.col("c")))).first())
    # how many counts are in each band of frequency tells from which count on LOOKUP words suffice
    band = F.floor(F.log2("c") * 16).cast("int")
    bands = sorted(((r.b, r.n) for r in counts.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = 1 << 30, LOOKUP
    for b, n in bands:
        room -= n
        if room < 0:
            break
        least = b
    head = counts.filter((band >= least) & (F.col("h") != end)).toArrow()
    code = make_code(head["h"].to_numpy().view(np.uint64), head["c"].to_numpy(), n_tokens, ends, bytes_seen)
    coded = int(code.count[code.count >= 2].sum())
    twice = int(counts.filter((F.col("c") >= 2) & (F.col("h") != end)).agg(F.sum("c")).first()[0] or 0) - coded  # tokens of the words after the escape that are seen twice or more
    once = max(1, n_tokens - ends - coded - twice)
    follows = learn.mapInArrow(_topics(spark.sparkContext.broadcast(code)), "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    topics = np.zeros((TOPIC + 1, 1 << DEPTH), np.int8)
    for r in follows.withColumn("topic", F.shiftright("k", DEPTH)).groupBy("topic").applyInArrow(_grown, "topic int, b binary").collect():
        topics[r.topic] = np.frombuffer(r.b, np.int8)
    code = spark.sparkContext.broadcast(replace(code, topics=topics))
    docs = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    buckets = max(LEAST, 1 << (n_tokens // DEAL).bit_length())
    kind = "bucket long, chunk long, n int, b binary"
    answers = docs.mapInArrow(_asked(code, buckets), kind).groupBy("bucket").applyInArrow(_answered(code, buckets), kind)
    packed = docs.mapInArrow(_packed, "chunk long, b binary")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, bits double, n_bytes long"
    rows = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(code, buckets, ends, n_words, n_tokens, twice + once, once), out)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score",
                       (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"), (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
