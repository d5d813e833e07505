"""Functions for SQL: table functions for windows and chunks, and the keyed hashes that built-ins lack."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def blake2b_hex(text: str, size: int = 8) -> str:
    """Digest of ``size`` bytes in hex."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).hexdigest()


def _blake2b64(s: pd.Series) -> pd.Series:
    """64-bit BLAKE2b in hex, which sorts as the number does; null for null."""
    return s.map(blake2b_hex, na_action="ignore")


class Windows:
    """windows(text, size, stride): what ``char_windows`` gives, as rows."""

    def eval(self, text: str, size: int, stride: int):
        if text is None:
            return
        n = len(text)
        if n <= size:
            yield 0, n, text
            return
        for s in range(0, n - size + 1, stride):
            yield s, s + size, text[s : s + size]
        if (n - size) % stride:
            yield n - size, n, text[n - size :]


class Chunks:
    """chunks(text, budget): spans of ``budget`` code points, as rows."""

    def eval(self, text: str, budget: int):
        for k, s in enumerate(range(0, len(text or ""), budget)):
            part = text[s : s + budget]
            yield k, s, s + len(part), len(part.encode("utf-8", "surrogatepass"))


def register(spark: SparkSession) -> None:
    """Makes windows, chunks and blake2b64 callable from SQL."""
    spark.udtf.register("windows", F.udtf(Windows, returnType="s int, e int, w string"))
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="chunk int, cs int, ce int, utf8_bytes int"))
    spark.udf.register("blake2b64", F.pandas_udf(_blake2b64, "string"))
