"""Folders that the driver and all executors share, and small session helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch: whole texts are long, so the default of 10,000 rows would need much memory.
BATCH_ROWS = 500


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where it is unset, a folder of our own if the session
    is local, as in tests; on a cluster that is an error, since executors would each write to their own disk."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfold-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared root that nobody else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:16]}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the session's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a URI, for code in tasks."""
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Move a finished file to its name. A retried or speculative task repeats the same bytes under the same name."""
    fs.move(temporary, final)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the JVM has collected their plans."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
