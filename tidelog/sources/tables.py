"""Readers of the stored tables. Declared schemas: no footer is read to plan a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import archive_run
from ..schemas import ARCHIVES, LOG_FILES, LOG_LINES, RUNS
from .folders import read_table
from .text_tree import list_files


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LOG_LINES)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LOG_FILES)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, RUNS)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ARCHIVES)


def discover_archives(spark: SparkSession, root: str) -> DataFrame:
    """Archive objects in storage, newest first; their contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    found = list_files(spark, root, "*.tar.gz").select(
        name.alias("filename"), archive_run(name).alias("run"), "size_bytes", F.col("mtime").alias("created_at"))
    return found.orderBy(F.col("filename").desc())
