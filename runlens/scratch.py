"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of the warehouse only in a local session that leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_runlens"
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings, until the block ends."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame once and reads it back: its lineage ends in shared files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Shuffled bytes that one of ``small_tasks`` reads, and the least partitions that adaptive execution starts from.
#: Tasks sort and group rows uncompressed, which takes ten times these bytes and more; a shuffle
#: into more partitions than 200 would hold a whole split of its input in memory on the other side.
TASK_BYTES, PARTITIONS = "8m", 200
#: Bytes of a file that such a task scans: what it sends to one partition of a shuffle can't be split on the other side.
SPLIT_BYTES = "16m"


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """The session with scans and shuffles by tasks of few rows: until all partitions are in use, their number grows with the input, not the rows of one."""
    parts = max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    adaptive = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts)}
    with settings(spark, {**adaptive, "spark.sql.files.maxPartitionBytes": SPLIT_BYTES}):
        yield


#: Shuffled files of a query are removed when it ends, not when the driver happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "spark.sql.parquet.compression.codec"


def spread(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` by tasks of few rows, in smaller files; what it shuffled is gone once it is written."""
    with small_tasks(df.sparkSession), settings(df.sparkSession, {CLEANUP: "true", CODEC: "zstd"}):
        return materialise(df, name)
