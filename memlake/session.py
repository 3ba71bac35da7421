"""Session helpers.  On a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", memory: str = "8g", app: str = "memlake") -> SparkSession:
    """A local session for tests and the benchmark."""
    partitions = str(os.cpu_count() if cpus == "*" else cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All times in the tables are UTC; results must not shift with the session's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_all_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan that has fewer tasks than there are cores; larger scans are left as they are.

    Meant for CPU-heavy text work on small tables: a small Parquet file is one row group and so one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal small rows that each cost much work, such as paths of files to be opened, over all tasks.

    Without a number Spark merges the tasks of such a shuffle by its bytes, so that one core would do the work of many.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach, below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a cluster a machine-local folder would be lost
    with its machine, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="memlake-")
    return f"{shared.rstrip('/')}/memlake-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: for results that several later steps read.

    The copy survives lost executors and, unlike a cached frame, is read column by column.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
