"""Writers that publish only what is complete: staged tables, reports, packed blocks, guarded manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import delete, exists_at, move, read_text, write_text


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], check: Callable[[DataFrame], None] | None = None, read: Callable[[str], DataFrame] | None = None) -> None:
    """Write beside ``path``, check what was written, and only then move it into place; nothing appears if the check raises."""
    spark = df.sparkSession
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(staged)
    try:
        write(df, staged)
        if check:
            check(read(staged) if read else spark.read.parquet(staged))
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
        had = fs.exists(p) and fs.rename(p, aside)  # what was there stays until the new one is in place
        if not fs.rename(tmp, p):
            if had:
                fs.rename(aside, p)
            raise OSError(f"{staged} can't be moved to {path}")
        if had:
            fs.delete(aside, True)
    finally:
        if fs.exists(tmp):
            fs.delete(tmp, True)


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """JSON lines of {"text": ...}."""
    publish(df.select(df[text].alias("text")), path, lambda d, p: d.write.json(p))


def write_report(path: str, value: dict) -> None:
    """Indented JSON with a line feed at the end, moved into place when complete."""
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    write_text(tmp, json.dumps(value, ensure_ascii=False, indent=2) + "\n")
    move(tmp, path)


def write_manifest(path: str, value: dict, force: bool = False, unfreeze: bool = False) -> None:
    """A manifest replaces another only with ``force``, and a frozen one only with ``unfreeze`` too."""
    if exists_at(path):
        if not force:
            raise FileExistsError(path)
        if json.loads(read_text(path)).get("frozen") is True and not unfreeze:
            raise PermissionError(f"{path} is frozen")
    write_report(path, value)


def write_blocks(df: DataFrame, path: str, meta: dict) -> None:
    """Packed blocks with their meta file, which goes first and comes last: where it stands, the blocks are complete."""
    delete(f"{path}/meta.json")
    df.write.mode("overwrite").parquet(f"{path}/blocks")
    write_report(f"{path}/meta.json", meta)


def may_publish(evaluated_sha256: str, weights_sha256: str) -> None:
    """Weights may go out only if they are the evaluated ones."""
    if evaluated_sha256 != weights_sha256:
        raise PermissionError("the weights are not the evaluated ones")
