"""Shared pieces: tables, intermediate results, sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows in an Arrow batch: long texts make batches of the usual 10,000 rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{work_dir(spark)}/lectern-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a uri with its file system: the default one's where it names none, as Spark resolves it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, label)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._lectern_path = path
    return made


def discard(*frames: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        if path := getattr(df, "_lectern_path", None):
            spark = df.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, of ``width`` bytes each at most, allow it; else with one for a merge join."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df.hint("merge")


def give_back() -> None:
    """Return what a Python worker has freed to the system: idle workers wait beside the next stage's tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
