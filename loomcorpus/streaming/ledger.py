"""Ledgers as streams: append-only JSON in, one row per run and step out, effectively once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import latest
from ..operators.quality import GateError
from ..operators.splits import sample
from ..sources.readers import LEDGER


def read_stream(spark: SparkSession, path: str, fmt: str = "json", schema: str = LEDGER) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


#: Parts of a ledger's state, by run; a micro-batch rewrites those alone that it brings rows of.
BUCKETS = 32


def _listed(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers N of the folders ``name``=N under ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _newest(spark: SparkSession, state: str, before: int | None = None) -> dict[int, list[int]]:
    """For each bucket the epochs that hold it, rising, only those ``before`` an epoch."""
    have: dict[int, list[int]] = {}
    for e in _listed(spark, state, "epoch"):
        if before is None or e < before:
            for k in _listed(spark, f"{state}/epoch={e}", "bucket"):
                have.setdefault(k, []).append(e)
    return have


def accumulate(stream: DataFrame, state: str, checkpoint: str):
    """Runs over all that is there and stops.  Each micro-batch merges into the tables at ``state``: of every run and
    step the row logged last stays.  The state is parted by run, so a batch reads and writes the parts of its own runs only.
    A batch that is run again changes nothing, for its tables are named by its number; of each part the table before stays for that."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        have = _newest(spark, state, epoch)
        for k in touched:
            if k in have:
                rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{state}/epoch={have[k][-1]}/bucket={k}").withColumn("bucket", F.lit(k)))
        latest(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/epoch={epoch}")
        for k in touched:
            for e in have.get(k, [])[:-1]:
                _drop(spark, f"{state}/epoch={e}/bucket={k}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The merged table after the last batch."""
    paths = [f"{state}/epoch={e[-1]}/bucket={k}" for k, e in _newest(spark, state).items()]
    return spark.read.parquet(*paths)


def reservoir(stream: DataFrame, k: int, state: str, checkpoint: str, seed: int = 42):
    """Keeps the ``k`` distinct keys of least seeded hash among all that the stream has brought: the sample of ``splits.sample``, whatever the batches.

    ``stream``: key.  The state is one table of at most ``k`` rows (and ties) for each batch; the one before the last stays, so a batch can be run again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        older = [e for e in _listed(spark, state, "epoch") if e < epoch]
        keys = batch.select("key") if not older else batch.select("key").unionByName(spark.read.schema("key string").parquet(f"{state}/epoch={older[-1]}"))
        sample(keys, k, seed).select("key").write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
        for e in older[:-1]:
            _drop(spark, f"{state}/epoch={e}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reservoir_keys(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/epoch={_listed(spark, state, 'epoch')[-1]}")


def check_cursor(cursor: int, update: int, batch: int, accum: int) -> None:
    """A resumed reader must stand where the updates say: every update takes ``batch`` x ``accum`` sequences."""
    if cursor != update * batch * accum:
        raise GateError(f"the cursor is {cursor}, but {update} updates took {update * batch * accum}")


def event_windows(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum and mean per tumbling window and key, closed by a watermark."""
    t = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return t.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def keep_windows(windows: DataFrame, path: str, checkpoint: str):
    """Runs ``event_windows`` over all that a stream has and stops; the windows after the last batch stand at ``path``."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for e in _listed(batch.sparkSession, path, "epoch"):
            if e < epoch - 1:
                _drop(batch.sparkSession, f"{path}/epoch={e}")

    return windows.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/epoch={_listed(spark, path, 'epoch')[-1]}")
