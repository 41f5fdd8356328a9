"""Vectorised words, shingles and hashes over Arrow string columns.

A chunk of rows is viewed as one byte buffer. Word limits come from a 256-entry class table, and the 64-bit hash of every
word from one running sum of ``table[byte] * P**i`` modulo 2**64; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at a time; a longer text is a chunk of its own
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False  # words are [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SEATS = _rng.integers(1, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers = tuple(out)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the len+1 offsets of its rows; null is empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, so that working memory doesn't follow the batch size."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        offs = buffer(col)[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a chunk: byte limits, and ``rows[i]:rows[i+1]`` are the words of row i."""

    buf: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def hashes(self) -> np.ndarray:
        return span_hash(self.buf, self.starts, self.ends)


def words(col: pa.Array, kind: np.ndarray = SPACE, lower: bool = False) -> Words:
    buf, offs = buffer(col)
    if lower:
        buf = LOWER[buf]
    inside = kind[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(buf, offs, starts, ends, np.searchsorted(starts, offs))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``buf``; equal spans have equal hashes anywhere."""
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the ``k`` values from each position on (len(h) - k + 1 of them); ``seed`` 1 gives a second, other hash."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _SEATS[seed, j]
    return mix(out)


def long(x: np.ndarray) -> pa.Array:
    """uint64 hashes as an Arrow bigint column."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that equal neighbouring keys stay together, of about ``most`` bytes or one key's rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, max(1, batch.num_rows * most // max(most, batch.nbytes)))
            at += part.num_rows
            held.append(part)
            size += part.nbytes
            if size < most:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = whole.column(key).to_numpy()
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if last:
                yield whole.slice(0, last).to_batches()[0]
                held, size = whole.slice(last).to_batches(), 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
