"""Folders on shared storage for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SHARED = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, prefix: str = "tidelog") -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session gets a folder of its machine; on a cluster that would lose what executors
    write, so it is an error there.
    """
    root = spark.conf.get(SHARED, None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix=f"{prefix}-")
            context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it does not exist. For folders of runs, not of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder from whatever storage it is on. Spark has no public call for that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark_folder(spark: SparkSession, folder: str) -> None:
    """Make an empty folder, which happens at once or not at all: the point from which what it marks counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path):
        raise OSError(f"cannot make {folder}")
