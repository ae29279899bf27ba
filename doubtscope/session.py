"""Session helpers: the shared scratch folder and the sessions used by tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only on a local master may a temporary folder take its place; on a cluster each executor would
    write to its own disk, so a missing setting is an error there.
    """
    context = spark.sparkContext
    base = spark.conf.get(_CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if base is None and not re.match(r"local(\[|$)", context.master):
        raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="doubtscope-"))
    return (base or context.getCheckpointDir()).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a temporary table, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, waves: int = 1) -> DataFrame:
    """Deal rows to all cores when the input has fewer splits than ``waves`` times the cluster's cores.

    For heavy work per row on small or badly split files; larger inputs are not shuffled. Several
    waves even out rows of unequal cost.
    """
    parts = waves * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def dealt(df: DataFrame, waves: int = 1) -> DataFrame:
    """Deal rows to ``waves`` tasks a core at least, however many splits the input has.

    For heavy work per row: of the splits of a file with one long row group, one holds every row. Shuffles the input once.
    """
    return df.repartition(max(df.rdd.getNumPartitions(), waves * df.sparkSession.sparkContext.defaultParallelism))


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench; cluster jobs bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("doubtscope")
        .config("spark.driver.memory", os.environ.get("DOUBTSCOPE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
