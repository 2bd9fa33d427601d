"""Session-level helpers: where shared scratch data lives and how lineage is cut."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run in Python there."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._corpusloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private temporary one only on a local master that names none."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(f"name a folder that all executors share in {CHECKPOINT_SETTING}")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written and read back."""
    return f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for loops that would otherwise grow the plan each round."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results that several later steps read: the expensive work runs once, survives lost
    executors, and each reader still prunes columns and pushes filters into the files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only an input that has fewer partitions than the cluster has cores.

    Heavy per-row work on one small unsplittable file would use one core; a large input has
    many splits already and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, size: int) -> bool:
    """Hand rows to Python in batches of about `size` bytes, unless the session has a size of its own; True if it is set now.

    Every running task holds a batch twice, outside the executor's heap and in its Python worker. Spark reads the
    setting when a query runs, not when it is written down, so it has to stay until then.
    """
    if spark.conf.get(BATCH_SETTING, None) is not None:
        return False
    spark.conf.set(BATCH_SETTING, str(size))
    return True


def give_back() -> None:
    """Return freed memory to the system: Python workers stay alive between tasks, and their next one may need none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
