"""Leakage-free splits by content: holdouts, frozen validation sets, samples and rebuilding from a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key, is_blank, seeded
from ..session import materialize
from .joins import join_keyed
from .order import kth_smallest, row_numbers, smallest
from .quality import GateError


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``key``; rows with a null or blank text are left out, as no operator on documents counts them."""
    return df.filter(~is_blank(text)).withColumn("key", content_key(text))


def distinct_keys(df: DataFrame) -> DataFrame:
    return df.select("key").distinct()


def first_of_each(df: DataFrame, order: str) -> DataFrame:
    """One row per key, the one lowest in ``order``: key, ``order``, copies."""
    return df.groupBy("key").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def split_by_row_hash(df: DataFrame, row: str, n: int, seed: int = 42) -> DataFrame:
    """Adds ``split``: 'val' for the ``n`` rows of least seeded hash of their number, else 'train'."""
    hashed = df.withColumn("h", seeded(seed, row))
    chosen = smallest(hashed, "h", n).select(row, F.lit("val").alias("split"))
    return df.join(chosen, row, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def holdout(source: DataFrame, held: DataFrame, exclude: DataFrame) -> dict[str, DataFrame]:
    """Keys to hold out (``held`` without ``exclude``), and the source parted into train rows and held-out rows, by content.

    All occurrences of a held-out text leave the training rows.
    """
    val = held.select("key").distinct().join(exclude.select("key").distinct(), "key", "left_anti")
    return {"val": val, "train": source.join(val, "key", "left_anti"), "heldout": source.join(val, "key", "left_semi")}


def bottom_k(train: DataFrame, old: DataFrame, target: int, enough: bool = False) -> DataFrame:
    """The smallest distinct keys of ``train`` that are not in ``old``, as many as ``target`` still needs; with ``enough``, GateError if there are too few.

    The threshold comes from counts of the keys' first 60 bits, so no more than keys that agree in those are ever sorted.
    """
    need = max(0, target - old.select("key").distinct().count())
    fresh = materialize(distinct_keys(train).join(distinct_keys(old), "key", "left_anti").withColumn("h", F.conv(F.substring("key", 1, 15), 16, 10).cast("bigint")), "fresh")
    if need == 0:
        return fresh.limit(0).select("key")
    top = kth_smallest(fresh, "h", need)
    if top is None:
        if enough:
            raise GateError(f"fewer than {need} new documents")
        return fresh.select("key")
    below = fresh.filter(F.col("h") < top)
    ties = fresh.filter(F.col("h") == top).orderBy("key").limit(need - below.count())
    return below.unionByName(ties).select("key")


def freeze(train: DataFrame, old: DataFrame, old_order: str, target: int) -> DataFrame:
    """The frozen set: old documents in their order, then the new ones by key: i, key, is_new."""
    was = first_of_each(old, old_order).select("key", F.col(old_order).cast("bigint").alias("ord"), F.lit(0).alias("is_new"))
    new = bottom_k(train, old, target).select("key", F.lit(0).cast("bigint").alias("ord"), F.lit(1).alias("is_new"))
    return row_numbers(was.unionByName(new), ["is_new", "ord", "key"], "i").select("i", "key", "is_new")


def sample(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` distinct documents, uniform without replacement, the same for every partitioning: the least seeded hashes of keys."""
    return smallest(distinct_keys(df).withColumn("h", seeded(seed, "key")), "h", k)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``pos``, the place of each row in a seeded permutation."""
    return row_numbers(df.withColumn("h", seeded(seed, key)), ["h", key], "pos").drop("h")


def rebuild(manifest: DataFrame, upstream: DataFrame, order: str) -> DataFrame:
    """Manifest rows with their document, the first of its hash in ``order``: i, sha256, line (null if missing).

    Hashes compare without case; rows with a null number or hash are left out, repeated rows count once.
    """
    wanted = manifest.filter("i is not null and sha256 is not null").select("i", F.lower("sha256").alias("key")).distinct()
    have = first_of_each(upstream, order)
    counts = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = join_keyed(wanted, have.select("key", F.col(order).alias("line")).join(counts, "key"), ["key"], "n")
    missing = wanted.join(have, "key", "left_anti").withColumn("line", F.lit(None).cast("bigint"))
    return found.unionByName(missing).select("i", F.col("key").alias("sha256"), "line")


def below(df: DataFrame, number: str, n: int) -> DataFrame:
    """The rows numbered below ``n``: a limit that reaches the scan as a filter and always takes the same rows."""
    return df.filter(F.col(number) < n)
