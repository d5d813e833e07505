"""Session factory and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", name: str = "loomcorpus") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (local tests), a temporary one is set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    made = getattr(spark.sparkContext, "_loomcorpus_dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="loomcorpus-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        made = "file://" + folder
        spark.sparkContext._loomcorpus_dir = made
        spark.sparkContext.setCheckpointDir(made)
    return made


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their Python finds it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_loomcorpus_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as work:
        tree = Path(work, "tree", "loomcorpus")
        shutil.copytree(root / "loomcorpus", tree, ignore=shutil.ignore_patterns("__pycache__"))
        packed = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="loomcorpus-"), "loomcorpus")), "zip", Path(work, "tree"))
    sc.addPyFile(packed)
    sc._loomcorpus_shipped = True


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and keeps column pruning and pushed
    filters for everything that reads it afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _written(spark: SparkSession) -> list[str]:
    """Tables that ``materialize`` wrote in this context."""
    sc = spark.sparkContext
    if not hasattr(sc, "_loomcorpus_written"):
        sc._loomcorpus_written = []
    return sc._loomcorpus_written


def release(spark: SparkSession) -> int:
    """Deletes all tables that ``materialize`` has written, once the results that read them are stored or collected; how many there were."""
    written, jvm = _written(spark), spark._jvm
    for path in written:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    n = len(written)
    written.clear()
    return n


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """In at least ``per_core`` parts for each core, for work that costs far more than moving its rows; what has as many parts already stays as it is."""
    parts = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
