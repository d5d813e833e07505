"""Problem 1: a reproducible sample that stays stable as data grows, by epoch-rate selection.

A key (here a digest of the text) is chosen if its random number is below the rate of the epoch
in which it was first seen.  The number comes from a counter-based generator (Philox 4x32-10)
keyed by the seed with the identifier as its counter, so it depends on nothing else: not on
order, partitioning, or other rows.  First-seen epochs and the rate frozen with each epoch are
persisted in a ledger, so later changes of the rate touch new keys only.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_keyed
from ..session import materialize

#: Fixed values of Philox 4x32: multipliers and key increments.
_M0, _M1, _W0, _W1 = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85


def philox4x32(counter: np.ndarray, key: tuple[int, int], rounds: int = 10) -> np.ndarray:
    """``counter``: n x 4 words of 32 bits; the same shape of random words."""
    c = [counter[:, i].astype(np.uint64) for i in range(4)]
    k0, k1 = key
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for _ in range(rounds):
        a, b = c[0] * np.uint64(_M0), c[2] * np.uint64(_M1)
        c = [(b >> half) ^ c[1] ^ np.uint64(k0), b & low, (a >> half) ^ c[3] ^ np.uint64(k1), a & low]
        k0, k1 = (k0 + _W0) & 0xFFFFFFFF, (k1 + _W1) & 0xFFFFFFFF
    return np.stack(c, axis=1).astype(np.uint32)


def uniform(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) of 53 bits for 128-bit identifiers."""
    hi, lo = hi.astype(np.int64).view(np.uint64), lo.astype(np.int64).view(np.uint64)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    words = np.stack([hi >> half, hi & low, lo >> half, lo & low], axis=1)
    r = philox4x32(words, (seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF)).astype(np.uint64)
    return ((r[:, 0] << np.uint64(21)) | (r[:, 1] >> np.uint64(11))).astype(np.float64) / 2.0**53


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds k0, k1, the 128-bit identifier of the text; equal texts are one identity."""
    digest = F.sha2(F.col(text_col), 256)
    word = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("bigint")
    both = lambda i: F.shiftleft(word(i), 32).bitwiseOR(word(i + 8))
    return df.withColumn("k0", both(1)).withColumn("k1", both(17))


def with_number(df: DataFrame, seed: int = 0) -> DataFrame:
    @F.pandas_udf("double")
    def number(hi: pd.Series, lo: pd.Series) -> pd.Series:
        return pd.Series(uniform(hi.to_numpy(), lo.to_numpy(), seed))

    return df.withColumn("u", number("k0", "k1"))


#: Names of columns that are added or used; columns of the input with these names give way.
_OWN = ("k0", "k1", "u", "epoch", "rate", "rows_", "seen_")


def _without_own(df: DataFrame, text_col: str) -> DataFrame:
    return df.drop(*[c for c in _OWN if c != text_col])


def _rate(epoch: str, rates: dict[int, float] | None, rate: float):
    c = F.lit(rate)
    for e, r in sorted((rates or {}).items()):
        c = F.when(F.col(epoch) == e, F.lit(float(r))).otherwise(c)
    return c


def sample(df: DataFrame, epoch_col: str, rate: float = 0.1, rates: dict[int, float] | None = None, text_col: str = "text", seed: int = 0) -> DataFrame:
    """The rows of ``df`` whose text is chosen, with epoch (first seen), rate and u added.

    The first-seen epoch is the least ``epoch_col`` of equal texts, so later deliveries never
    change it; ``rates`` freezes other rates than ``rate`` for single epochs.  Rows with a null
    text are never chosen; a null epoch counts as the last, at ``rate``.  Repeated rows are chosen together.
    The added columns replace any of the same name.
    """
    base = _without_own(df.withColumn("seen_x", F.col(epoch_col)), text_col).withColumnRenamed("seen_x", "seen_")
    keyed = with_number(with_key(base.filter(F.col(text_col).isNotNull()), text_col), seed)
    top = max([rate, *(rates or {}).values()])
    likely = keyed.filter(F.col("u") < top)  # pre-filter: nothing else can be chosen
    slim = materialize(likely, "likely")
    first = slim.groupBy("k0", "k1").agg(F.min("seen_").alias("epoch"), F.count(F.lit(1)).alias("rows_"))
    first = first.withColumn("rate", _rate("epoch", rates, rate))
    return join_keyed(slim, first, ["k0", "k1"], "rows_").filter(F.col("u") < F.col("rate")).drop("k0", "k1", "seen_")


class Ledger:
    """First-seen epochs and the rates frozen with them, persisted under ``path``: nothing written is ever changed.

    ``keys/epoch=N`` holds the identities first seen in epoch N, ``rates/epoch=N`` the rate of that epoch, as given at its first
    delivery.  Later deliveries of an epoch add identities at that rate, whatever rate they bring.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, seed: int = 0):
        self.spark, self.path, self.seed = spark, path, seed

    def _epochs(self, kind: str) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("epoch="))

    def _read(self, kind: str, schema: str) -> DataFrame:
        if not self._epochs(kind):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")

    def rates(self) -> dict[int, float]:
        """The frozen rate of every epoch."""
        return {r["epoch"]: r["rate"] for r in self._read("rates", "rate double, epoch int").collect()}  # one row for each epoch

    def keys(self) -> DataFrame:
        """k0, k1, epoch, rate of every identity seen so far; one that a broken delivery left twice counts in its first epoch."""
        seen = self._read("keys", "k0 bigint, k1 bigint, epoch int")
        return seen.groupBy("k0", "k1").agg(F.min("epoch").alias("epoch")).withColumn("rate", _rate("epoch", self.rates(), 0.0))

    def record(self, df: DataFrame, epoch: int, rate: float, text_col: str = "text") -> None:
        """Adds the identities of ``df`` that no delivery has brought before, with ``epoch``."""
        frozen = self.rates()
        if any(e > epoch for e in frozen):
            raise ValueError("epochs must be delivered in order")
        if epoch not in frozen:
            self.spark.range(1).select(F.lit(float(rate)).alias("rate")).coalesce(1).write.parquet(f"{self.path}/rates/epoch={epoch}")
        keyed = with_key(_without_own(df, text_col).filter(F.col(text_col).isNotNull()), text_col).select("k0", "k1").distinct()
        new = keyed.join(self._read("keys", "k0 bigint, k1 bigint, epoch int").select("k0", "k1"), ["k0", "k1"], "left_anti")
        materialize(new, "new_keys").write.mode("append").option("compression", "zstd").parquet(f"{self.path}/keys/epoch={epoch}")

    def chosen(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of ``df`` whose identity is in the ledger with a number below its rate; epoch, rate and u are added."""
        top = max(self.rates().values(), default=0.0)
        keyed = with_number(with_key(_without_own(df, text_col).filter(F.col(text_col).isNotNull()), text_col), self.seed).filter(F.col("u") < top)
        sized = keyed.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("rows_")).join(self.keys(), ["k0", "k1"])
        return join_keyed(keyed, sized, ["k0", "k1"], "rows_").filter(F.col("u") < F.col("rate")).drop("k0", "k1")

    def deliver(self, df: DataFrame, epoch: int, rate: float, text_col: str = "text") -> DataFrame:
        """Records ``df`` and returns its chosen rows.  An epoch can be delivered again, with the same or with other rows: what was chosen stays chosen."""
        self.record(df, epoch, rate, text_col)
        return self.chosen(df, text_col)
