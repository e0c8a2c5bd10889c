"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Where a local session without a checkpoint folder keeps its tables.
_OWN = "wayfold.own.tables"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a folder of its own;
    on a cluster that is an error, since executors would each write to their own disk."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get(_OWN, None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set(_OWN, root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared root that nobody else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:16]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage in a way that survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a URI, for code in tasks and sources."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
