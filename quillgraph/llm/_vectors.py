"""Whole-number vectors from a float array column, packed for Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256.0


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds no null, NaN or infinity."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.filter(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))


def width(rows: DataFrame, vector: str = "embedding") -> int:
    """Components of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def limit(d: int) -> int:
    """Components are held within this, so that no sum over ``d`` squared differences leaves 64 bits."""
    return int(np.sqrt((2.0**63 - 1) / max(d, 1)) / 2) - 1


def whole(col: pa.Array, d: int) -> np.ndarray:
    """``floor(256 x)`` of each component, x as double; rows are padded with zeros to ``d``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    n = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    most = limit(d)
    flat = np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64)
    if len(n) and (n == d).all():
        return flat.reshape(len(n), d)
    out = np.zeros((len(n), d), np.int64)
    out[np.arange(d) < n[:, None]] = flat
    return out


def packed(q: np.ndarray) -> pa.Array:
    """One binary value a row."""
    n, d = q.shape
    data = np.ascontiguousarray(q, np.int64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * d), n, [None, pa.py_buffer(data)]).cast(pa.binary()) if d else pa.array([b""] * n, pa.binary())


def unpacked(col: pa.Array, d: int) -> np.ndarray:
    """The rows of ``packed``."""
    if not len(col) or not d:
        return np.zeros((len(col), d), np.int64)
    col = col.cast(pa.large_binary())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int64).reshape(len(col), d)
