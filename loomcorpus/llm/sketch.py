"""Sketches of fixed size, built per partition and merged: count-min with saturating cells, and bitmaps.

What reaches the driver is two bits for each cell, whatever the size of the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix

_BLOCK = 1 << 20
_SCHEMA = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64((row * 0x632BE59BD9B4E019 + 0x1F) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)).astype(np.int64)


def bits_for(keys: int) -> int:
    """Cells for ``keys`` keys: eight for each, between 2**20 and 2**28; more keys than that only make the sketch keep more."""
    return min(28, max(20, int(8 * max(keys, 1)).bit_length()))


class Repeated:
    """Which keys a merged count-min sketch estimates to occur twice or more; overestimates, never under."""

    def __init__(self, more: np.ndarray, depth: int, bits: int):
        self.more, self.depth, self.bits = more, depth, bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for d in range(self.depth):
            c = cells(keys, d, self.bits) + (d << self.bits)
            ok &= (self.more[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return ok


def _pack(b: bytes) -> bytes:
    return zlib.compress(b, 1)


def _sketch(df: DataFrame, key: str, depth: int, bits: int, which: str) -> Repeated:
    size = (depth << bits) >> 3
    step = min(_BLOCK, size)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more, seen = np.zeros(size, np.uint8), np.zeros(size, np.uint8), False
        for b in batches:
            keys = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            seen |= len(keys) > 0
            for d in range(depth):
                c, n = np.unique(cells(keys, d, bits) + (d << bits), return_counts=True)
                bit = (1 << (c & 7)).astype(np.uint8)
                had = (once[c >> 3] & bit) > 0
                again = had | (n > 1)
                np.bitwise_or.at(once, c >> 3, bit)
                np.bitwise_or.at(more, c[again] >> 3, bit[again])
        if seen:
            for i in range(0, size, step):
                o = once[i : i + step]
                if o.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // step], pa.int32()), pa.array([_pack(o.tobytes())]), pa.array([_pack(more[i : i + step].tobytes())])], schema=_SCHEMA)


    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for i, o, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                o, m = (np.frombuffer(zlib.decompress(x), np.uint8).copy() for x in (o, m))
                if i in have:
                    a = have[i]
                    a[1] |= m | (a[0] & o)
                    a[0] |= o
                else:
                    have[i] = [o, m]
        for i, (o, m) in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_pack(o.tobytes())]), pa.array([_pack(m.tobytes())])], schema=_SCHEMA)

    schema = "block int, once binary, more binary"
    blocks = -(-size // step)
    parts = df.select(F.col(key).cast("bigint").alias("key")).mapInArrow(part, schema)
    out = np.zeros(size, np.uint8)
    got = parts.repartition(blocks, "block").mapInArrow(merged, schema).select("block", which).collect()  # at most ``size`` bytes
    for i, b in got:
        out[i * step : (i + 1) * step] = np.frombuffer(zlib.decompress(b), np.uint8)
    return Repeated(out, depth, bits)


def repeated(df: DataFrame, key: str, bits: int = 24, depth: int = 2) -> Repeated:
    """Count-min over ``key``: the cells of two or more. A key that occurs twice always holds."""
    return _sketch(df, key, depth, bits, "more")


def members(df: DataFrame, key: str, bits: int = 24, depth: int = 1) -> Repeated:
    """A bitmap of the keys that occur at all; false positives only."""
    return _sketch(df, key, depth, bits, "once")


def keep(df: DataFrame, key: str, sketch: Repeated) -> DataFrame:
    """The rows whose ``key`` the sketch holds; only the key travels to Python."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(sketch)

    @F.pandas_udf("boolean")
    def holds(s: pd.Series) -> pd.Series:
        keys = s.fillna(0).to_numpy(np.int64)
        return pd.Series(held.value.holds(keys) & s.notna().to_numpy())

    return df.filter(holds(F.col(key).cast("bigint")))
