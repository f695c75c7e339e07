"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    It serves drivers started elsewhere; a cluster has the package installed or shipped.
    """
    root, held = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([root, *paths])


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the memory of Python workers and Arrow buffers for tables of long texts.

    It stays set for the session: plans made here are run later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; paths are never written twice."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    This cuts the lineage through the shared folder, so neither a lost executor nor
    a chain of ordered steps recomputes it, and its true size is known to the
    planner, which then decides about broadcasting.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _settled.append(path)
    return df.sparkSession.read.parquet(path)


_settled: list[str] = []


def clean_up(spark: SparkSession) -> int:
    """Remove the intermediate tables that this driver has settled; returns their number.

    To be called when their results have been read or written elsewhere, at the end of a job.
    """
    n, conf = len(_settled), spark._jsc.hadoopConfiguration()
    while _settled:
        path = spark._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def shuffle_width(spark: SparkSession, df: DataFrame | None = None, target: int = 64 << 20) -> int:
    """Number of ranges to cut ordered work into: one per shuffle task, fewer for a table
    that the planner knows to be small (``target`` bytes a range)."""
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df is None:
        return tasks
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, min(tasks, size // target + 1))


def bench_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
