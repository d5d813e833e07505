"""Global order without a global sort in one task: prefix sums, row numbers, k-th smallest values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Adds, for each ``values`` entry name -> column, the sum of the column over all rows before the row in ``order``.

    Two levels: rows are partitioned by range of ``order`` (which must be unique for a defined
    result), sums are taken within partitions by a window, and the totals of partitions before, one row per partition, are
    added.  Nulls count as 0.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_pid").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{k}") for k, c in values.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    within = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(base), "_pid")
    for k, c in values.items():
        out = out.withColumn(k, (F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0))).cast("bigint"))
    return out.drop("_pid", *[f"_b_{k}" for k in values])


def row_numbers(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """Adds the 0-based position of each row in ``order``."""
    return prefix_sums(df.withColumn("_one", F.lit(1)), order, {name: "_one"}).drop("_one")


def kth_smallest(df: DataFrame, col: str, k: int, bits: int = 60, step: int = 15) -> int | None:
    """The k-th smallest (from 1) value of a non-negative BIGINT column, by radix selection.

    Each round counts the rows by the next ``step`` bits (at most 2**step groups reach the driver) and narrows to
    one group; None if there are fewer than ``k`` rows.
    """
    prefix, left, shift = 0, k, bits
    rows = materialize(df.select(F.col(col).alias("v")).filter("v is not null"), "values")  # read once for each round
    while shift > 0:
        shift -= step
        here = rows.filter(F.shiftright("v", shift + step) == prefix) if shift + step < bits else rows
        for b, n in sorted((r[0], r[1]) for r in here.groupBy(F.shiftright("v", shift).alias("b")).count().collect()):
            if left <= n:
                prefix = b
                break
            left -= n
        else:
            return None
    return prefix


def smallest(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose ``col`` is at most the k-th smallest; ties at the threshold all come, all rows if there are fewer than ``k``."""
    if k <= 0:
        return df.limit(0)
    t = kth_smallest(df, col, k)
    return df if t is None else df.filter(F.col(col) <= t)
