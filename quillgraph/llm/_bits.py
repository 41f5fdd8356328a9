"""A set of 64-bit hashes as one bit array of fixed size, built in slices by the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2 MB, whatever the number of hashes; more hashes only let more through to the exact join
SLICES = 64


def bit_filter(hashes: DataFrame, bits: int = BITS) -> bytes:
    """Bit ``h mod 2**bits`` is set for every ``h`` of the bigint column ``h``; nulls are ignored."""
    wide = (1 << bits) // SLICES

    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for part in batches:
            at = part.column(0).to_numpy(zero_copy_only=False)
            for s in np.unique(at // wide).tolist():
                seen.setdefault(s, np.zeros(wide, bool))[at[at // wide == s] - s * wide] = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in seen.values()], pa.binary())], ["s", "b"])

    at = hashes.filter("h is not null").select(F.pmod("h", F.lit(1 << bits)).alias("at")).distinct()
    out = bytearray((1 << bits) // 8)
    for s, b in at.repartition(SLICES, F.floor(F.col("at") / wide)).mapInArrow(run, "s long, b binary").collect():
        now = np.frombuffer(out, np.uint8, wide // 8, s * wide // 8) | np.frombuffer(bytes(b), np.uint8)
        out[s * wide // 8 : (s + 1) * wide // 8] = now.tobytes()
    return bytes(out)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes have their bit set; ``bits`` is the array of ``bit_filter`` as uint8."""
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose bigint ``key`` isn't in the one column of ``gone``; a null key stays.

    A plain anti join would shuffle every text. A bit array of at most 16 MB passes the rows that are surely not meant,
    on the scan; the others, few unless most rows go, are joined exactly.
    """
    gone = gone.toDF("_qg_gone")
    stay, some = split(docs, key, gone)
    return stay.unionByName(some.join(gone, key == F.col("_qg_gone"), "left_anti"))


def split(docs: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose bigint ``key`` is surely not in the one column of ``wanted`` (null keys among them), and the rest,
    told apart on the scan by a bit array of at most 16 MB."""
    gone = wanted.toDF("_qg_gone")
    n = gone.count()
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(gone.select(gone["_qg_gone"].alias("h")), min(27, max(16, (64 * n).bit_length()))))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        known = h.notna().to_numpy()
        out = np.zeros(len(h), bool)
        out[known] = has(np.frombuffer(bits.value, np.uint8), h[known].to_numpy(np.int64).view(np.uint64))
        return pd.Series(out)

    flag = key.isNotNull() & maybe(F.coalesce(key, F.lit(0)))
    return docs.filter(~flag), docs.filter(flag)
