"""Named data-quality gates: each counts its violations, and ``enforce`` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate found violations."""


def rows(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """Rows for which ``bad`` is true."""
    return df.agg(F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias("violations")).select(F.lit(name).alias("gate"), "violations")


def duplicates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("gate"), "violations")


def overlap(a: DataFrame, b: DataFrame, name: str, key: str) -> DataFrame:
    """Distinct keys on both sides."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return both.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("gate"), "violations")


def missing(a: DataFrame, b: DataFrame, name: str, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    gone = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("gate"), "violations")


def equal_counts(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of two row counts."""
    x, y = a.agg(F.count(F.lit(1)).alias("x")), b.agg(F.count(F.lit(1)).alias("y"))
    return x.join(F.broadcast(y), how="cross").select(F.lit(name).alias("gate"), F.abs(F.col("x") - F.col("y")).alias("violations"))  # one row each


def within(name: str, value: float, expected: float, tolerance: float) -> bool:
    """Relative deviation gate for scalars."""
    ok = abs(value - expected) <= tolerance * abs(expected)
    if not ok:
        raise GateError(f"{name}: {value} is not within {tolerance:g} of {expected}")
    return ok


def exactly(name: str, value: object, required: object) -> bool:
    """Equal in value and type: 1 is not True, and None only itself."""
    if type(value) is not type(required) or value != required:
        raise GateError(f"{name}: {value!r} is not {required!r}")
    return True


def report(gates: list[DataFrame]) -> DataFrame:
    """One row per gate."""
    return reduce(DataFrame.unionByName, gates)


def enforce(gates: list[DataFrame]) -> DataFrame:
    """The report as it was counted, or GateError with the gates that failed (one row each reaches the driver)."""
    got = report(gates)
    counted = got.collect()
    failed = [r for r in counted if r["violations"]]
    if failed:
        raise GateError("; ".join(f"{r['gate']}: {r['violations']}" for r in failed))
    return got.sparkSession.createDataFrame(counted, got.schema)
