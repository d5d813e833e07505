"""Tokenizer profiles: sizes by script, padding and truncation under a padded protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_cjk


def by_script(docs: DataFrame, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """Documents, characters, bytes, tokens and ratios of all documents, those with CJK and those without.

    All three groups are always there; ratios of an empty group are null.  Null texts don't count.
    """
    base = docs.filter(F.col(text).isNotNull()).select(F.when(has_cjk(text), "contains_cjk").otherwise("no_cjk").alias("c"), F.char_length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.col(tokens).alias("tokens"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chars", "bytes", "tokens")]
    got = base.groupingSets([[], [F.col("c")]], "c").agg(F.count(F.lit(1)).alias("docs"), *sums).withColumn("grp", F.coalesce("c", F.lit("all")))
    names = F.broadcast(docs.sparkSession.createDataFrame([("all",), ("contains_cjk",), ("no_cjk",)], "grp string"))
    out = names.join(got, "grp", "left").select("grp", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("docs", "chars", "bytes", "tokens")])
    ratio = lambda a: F.when(F.col("tokens") > 0, F.round(F.col(a) / F.col("tokens"), 6))
    return out.withColumn("chars_per_token", ratio("chars")).withColumn("bytes_per_token", ratio("bytes"))


def padding(docs: DataFrame, seq_len: int, tokens: str = "tokens") -> DataFrame:
    """Under one document per padded row of ``seq_len`` with two structural tokens: docs, padding, truncated, padding share."""
    t = F.col(tokens)
    one = docs.filter(t.isNotNull()).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.greatest(F.lit(0), F.lit(seq_len) - t - 2)), F.lit(0)).alias("pad"), F.coalesce(F.sum((t > seq_len - 2).cast("bigint")), F.lit(0)).alias("truncated"))
    return one.withColumn("share", F.when(F.col("docs") > 0, F.round(F.col("pad") / (F.col("docs") * seq_len), 6)))


def residual(chunks: DataFrame, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Tokens of all chunks less those of the whole documents, and as a percentage."""
    c = chunks.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("chunk_tokens"))
    d = docs.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("doc_tokens"))
    both = c.join(F.broadcast(d), how="cross")  # one row each
    return both.withColumn("overhead", F.col("chunk_tokens") - F.col("doc_tokens")).withColumn("overhead_pct", F.when(F.col("doc_tokens") > 0, F.round(100 * F.col("overhead") / F.col("doc_tokens"), 6)))


def summary(df: DataFrame, value: str) -> DataFrame:
    """Least, mean and greatest value."""
    return df.agg(F.min(value).alias("least"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("greatest"))
