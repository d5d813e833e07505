"""Small files on the file system that the tables lie on: Hadoop's where a session runs, else the local one."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _hadoop(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark, p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _local(path: str) -> str:
    return path.removeprefix("file://")


def exists_at(path: str) -> bool:
    h = _hadoop(path)
    return h[1].exists(h[2]) if h else os.path.exists(_local(path))


def delete(path: str) -> None:
    """Removes a file if it is there."""
    if not exists_at(path):
        return
    if h := _hadoop(path):
        h[1].delete(h[2], False)
    else:
        os.remove(_local(path))


def read_text(path: str) -> str:
    """The whole of a small UTF-8 file; FileNotFoundError where there is none."""
    h = _hadoop(path)
    if h is None:
        with open(_local(path), encoding="utf-8") as f:
            return f.read()
    spark, fs, p = h
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    h = _hadoop(path)
    if h is None:
        os.makedirs(os.path.dirname(_local(path)) or ".", exist_ok=True)
        with open(_local(path), "w", encoding="utf-8") as f:
            f.write(text)
        return
    stream = h[1].create(h[2], True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def move(source: str, target: str) -> None:
    """Moves a file over another."""
    h = _hadoop(source)
    if h is None:
        os.replace(_local(source), _local(target))
        return
    spark, fs, p = h
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(p, to):
        raise OSError(f"{source} can't be moved to {target}")
