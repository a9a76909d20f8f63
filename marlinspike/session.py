"""Session helpers: a local session for tests, table access, shared checkpoint folder, worker import path."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlinspike")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver found it; without effect on results."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, ROOT] if p)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a DataFrame."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table with fewer partitions than the session has cores, spread over the cores; a larger one stays where it lies.

    For heavy per-row work on a small table, whose one file would otherwise keep one core busy; rows and results are the same.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; sets a folder of its own only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="marlinspike-checkpoint-")
        _delete_on_exit(spark, shared)
    sc.setCheckpointDir(shared)


def _delete_on_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where all executors can write; it is deleted when the driver ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, folder)
    return folder
