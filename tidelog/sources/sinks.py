"""Writers: the line table, text exports, compressed run archives; dropping runs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import archive_name, part_filename
from ..operators.export import split_parts
from ..operators.merge import export_lines
from ..schemas import ARCHIVES, PART_BYTES
from .folders import delete_folder
from .text_tree import list_files


def write_log_lines(lines: DataFrame, path: str) -> None:
    """Replace the runs present in ``lines``; partitioned so that run and namespace prune.

    Rows are rebalanced by run and namespace: small pieces are put together and a run or
    namespace that holds most of the data is split at run time, so files get an even size.
    """
    (lines.hint("rebalance", "run", "ns").sortWithinPartitions("run", "ns", "filename", "line_no")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "ns").parquet(path))


def write_text(lines: DataFrame, path: str, max_bytes: int = PART_BYTES,
               compression: str = "none") -> None:
    """Text files laid out ``run=<run>/file=<name>``, cut into parts of about ``max_bytes``.

    Lines move by ``(run, filename, part)``: a task gets whole parts and never a whole hot file.
    """
    parts = split_parts(lines, max_bytes)
    out = parts.withColumn("file", part_filename(F.col("filename"), F.col("part")))
    (out.repartition("run", "file")
     .sortWithinPartitions("run", "file", "line_no")
     .select("run", "file", F.col("line").alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", compression).partitionBy("run", "file").text(path))
    _drop_stale_parts(lines.sparkSession, path)


def _drop_stale_parts(spark: SparkSession, path: str) -> None:
    """Remove parts that an earlier, larger export of the same file left behind.

    All parts of one export carry its job's id in their file names, so of every file the newest id counts.
    """
    folder, step = F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)
    written = list_files(spark, path).select(
        F.regexp_extract("path", r"/run=([^/]+)/", 1).alias("run"),
        F.regexp_replace(F.regexp_replace(folder, r"\.part\d+\.log$", ""), r"\.log$", "").alias("stem"),
        F.regexp_extract(step, r"^part-\d+-(.{36})", 1).alias("job"),
        F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "mtime")
    newest = written.groupBy("run", "stem").agg(F.max_by("job", "mtime").alias("newest"))
    stale = written.join(newest, ["run", "stem"]).where(F.col("job") != F.col("newest")).select("folder").distinct()
    for row in stale.toLocalIterator():
        delete_folder(spark, unquote(row.folder))


def write_selection(lines: DataFrame, selection: DataFrame, path: str) -> None:
    """Export the chosen files; files that do not exist are left out."""
    write_text(export_lines(lines, selection), path)


def write_file(lines: DataFrame, run: str, filename: str, path: str) -> None:
    """Export one file; a missing one is an error."""
    chosen = lines.where((F.col("run") == run) & (F.col("filename") == filename))
    if chosen.isEmpty():
        raise FileNotFoundError(f"{run}/{filename}")
    write_text(chosen, path)


def archive_runs(lines: DataFrame, runs: Sequence[str], path: str, max_bytes: int = PART_BYTES) -> DataFrame:
    """Write some runs compressed, in one job, and return their ``archives`` rows from the bytes written.

    A run without a line gets no archive and gives no row.
    """
    spark = lines.sparkSession
    chosen = lines.where(F.col("run").isin(list(runs)))
    if not runs or chosen.isEmpty():
        return spark.createDataFrame([], ARCHIVES)
    drop_runs(spark, runs, path)
    write_text(chosen, path, max_bytes, "gzip")
    run = F.regexp_extract("path", r"/run=([^/]+)/", 1)
    written = list_files(spark, path, "*.gz").select(run.alias("run"), "size_bytes").where(F.col("run").isin(list(runs)))
    return written.groupBy("run").agg(F.sum("size_bytes").alias("size_bytes")).select(
        archive_name(F.col("run")).alias("filename"), "run", "size_bytes", F.current_timestamp().alias("created_at"))


def archive_run(lines: DataFrame, run: str, path: str, max_bytes: int = PART_BYTES) -> DataFrame:
    return archive_runs(lines, [run], path, max_bytes)


def write_archives(archives: DataFrame, path: str) -> None:
    """Insert or replace archive rows: an archive's key follows from its run, so its partition is it."""
    (archives.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))


RUN_NAME = re.compile(r"\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d")


def drop_runs(spark: SparkSession, runs: Sequence[str], *tables: str) -> None:
    """Remove the partitions of the given runs from every table partitioned by run."""
    for run in runs:
        if not RUN_NAME.fullmatch(run):
            raise ValueError(f"not a run name: {run!r}")
        for table in tables:
            delete_folder(spark, f"{table}/run={run}")
