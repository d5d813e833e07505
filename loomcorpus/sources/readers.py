"""Readers with validation at the source: text corpora, manifests, evaluations, ledgers, logs, packed blocks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .files import read_text

LEDGER = "run_id string, arm string, step bigint, seqs_consumed bigint, tokens_cum bigint, targets_cum bigint, text_targets_cum bigint, structural_targets_cum bigint, positions_cum bigint, utf8_bytes_cum bigint, flops_nominal_cum bigint, wall_seconds_cum double, lr double, grad_norm double, loss_nats_per_target double, train_bits_per_byte double, logged_at timestamp_ntz"
LOG_LINE = r"\((\d+)/(\d+)\), loss: ([0-9.]+)"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents: value, text, problem (null if the row is good).

    ``text`` must be a JSON string that isn't blank; a number is a problem, not a text.
    """
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.text", "variant"))
    text = F.when(kind == "STRING", F.try_variant_get(v, "$.text", "string"))
    problem = F.when(v.isNull(), "not json").when(text.isNull(), "text is not a string").when(is_blank(text), "text is blank")
    return spark.read.text(path).select("value", text.alias("text"), problem.alias("problem"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Validated texts; raises when a row with a problem is read."""
    rows = scan(spark, path)
    return rows.select(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "problem", F.substring("value", 1, 80))).cast("string")).otherwise(F.col("text")).alias("text"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """i, sha256, ok: whether the row has a number and 64 hex digits."""
    df = spark.read.schema("i bigint, sha256 string").json(path)
    return df.withColumn("ok", F.coalesce(F.col("i").isNotNull() & F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)))


def read_frozen_manifest(spark: SparkSession, path: str) -> DataFrame:
    """i, sha256 of a manifest that must number its rows from 0 without a gap, hold 64 hex digits in each and not be empty; raises otherwise."""
    df = read_manifest(spark, path)
    one = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("bad")).first()
    if not one["n"] or one["bad"] or one["d"] != one["n"] or one["lo"] != 0 or one["hi"] != one["n"] - 1:
        raise ValueError(f"{path} is no manifest: {one.asDict()}")
    return df.select("i", "sha256")


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Per-document rows of evaluation reports: index, utf8_bytes, tokens, nll_nats, chunks."""
    schema = "protocol string, per_document array<struct<index: bigint, utf8_bytes: bigint, tokens: bigint, nll_nats: double, chunks: bigint>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("protocol", F.explode("per_document").alias("d")).select("protocol", "d.*")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def log_losses(lines: DataFrame, value: str = "value") -> DataFrame:
    """step, total, loss of every log line of the form (step/total), loss: x."""
    part = lambda k: F.regexp_extract(value, LOG_LINE, k)
    return lines.filter(F.col(value).rlike(LOG_LINE)).select(part(1).cast("bigint").alias("step"), part(2).cast("bigint").alias("total"), part(3).cast("double").alias("loss"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log_losses(spark.read.text(path))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the bytes of every file under ``path``: path, length, sha256."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def content_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free fingerprint of a table: rows, and the sum of 60-bit row hashes as a decimal, so no list of rows is ever gathered."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def read_config(path: str, default: dict | None = None) -> dict:
    """A small JSON file on the driver; ``default`` where it is missing or damaged."""
    try:
        return json.loads(read_text(path))
    except (OSError, ValueError):
        if default is None:
            raise
        return default


def read_blocks(spark: SparkSession, path: str, seq_len: int, vocab: int | None = None, verify: bool = True) -> DataFrame:
    """Packed blocks; raises on reading a block of another length or with an id outside the vocabulary, and if the meta file is missing.

    Where the meta file states ``n_seq`` or a ``digest`` (of ``content_digest`` over seq_id and ids), ``verify`` compares them first.
    """
    meta = read_config(f"{path}/meta.json")
    if meta["seq_len"] != seq_len:
        raise ValueError(f"blocks of {meta['seq_len']}, not {seq_len}")
    df = spark.read.parquet(f"{path}/blocks")
    if verify and ("n_seq" in meta or "digest" in meta):
        one = content_digest(df, ["seq_id", "ids"]).first()
        for name, got in (("n_seq", one["rows"]), ("digest", str(one["digest"]))):
            if name in meta and meta[name] != got:
                raise ValueError(f"{name} of the blocks is {got}, not {meta[name]}")
    bad = F.size("ids") != seq_len
    if vocab is not None:
        bad = bad | F.exists("ids", lambda x: (x < 0) | (x >= vocab))
    return df.withColumn("ids", F.when(bad, F.raise_error(F.concat(F.lit("bad block "), F.col("seq_id").cast("string"))).cast("array<int>")).otherwise(F.col("ids")))
