"""Catalog tables (runs, log_files, archives): building, summarising, listing, maintaining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LEVELS, level_by_substring, level_counts
from ..functions.names import archive_run, run_timestamp
from ..functions.text import human_size
from .ordinals import head_lines

FILE_KEYS = ["run", "filename", "ns", "pod", "container"]


def file_totals(lines: DataFrame, keys: Sequence[str] = FILE_KEYS) -> DataFrame:
    """Bytes and lines per file; a line occupies its bytes and one line end."""
    return lines.groupBy(*keys).agg(
        F.sum(F.col("n_bytes") + 1).cast("bigint").alias("size_bytes"),
        F.count(F.lit(1)).alias("line_count"))


def index_files(lines: DataFrame, sample: int | None = None, keys: Sequence[str] = FILE_KEYS,
                order: Sequence[str] = ("line_no",)) -> DataFrame:
    """One catalog row per file: totals and level counts of the whole file, in one pass.

    With ``sample`` the levels of only the first ``sample`` lines are counted.
    """
    level = level_by_substring(F.col("line"))
    if sample is None or "line_no" in lines.columns:
        counted = level if sample is None else F.when(F.col("line_no") <= sample, level)
        return lines.groupBy(*keys).agg(
            F.sum(F.col("n_bytes") + 1).cast("bigint").alias("size_bytes"),
            F.count(F.lit(1)).alias("line_count"),
            *level_counts(counted))
    head = (head_lines(lines, sample, keys, order)
            .withColumn("_level", level)
            .groupBy(*keys).agg(*level_counts(F.col("_level"))))
    totals = file_totals(lines, keys)
    # Adding up two sets of partial rows, rather than joining them, keeps files with a null name part.
    both = totals.unionByName(head, allowMissingColumns=True)
    measures = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def index_runs(files: DataFrame) -> DataFrame:
    """One catalog row per run."""
    return (files.groupBy("run")
            .agg(F.count(F.lit(1)).alias("file_count"),
                 F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")))


def dashboard_stats(runs: DataFrame, archives: DataFrame) -> DataFrame:
    """Runs, files, archives, combined bytes and the newest run, as one row."""
    zero = F.lit(0).cast("bigint")
    both = runs.select(
        F.lit(1).cast("bigint").alias("run_n"), F.col("file_count").alias("file_n"), zero.alias("zip_n"),
        F.col("total_bytes").alias("bytes"), F.col("run").alias("run")
    ).unionByName(archives.select(
        zero.alias("run_n"), zero.alias("file_n"), F.lit(1).cast("bigint").alias("zip_n"),
        F.col("size_bytes").alias("bytes"), F.lit(None).cast("string").alias("run")))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return both.agg(
        total("run_n").alias("runs"), total("file_n").alias("files"), total("zip_n").alias("zips"),
        total("bytes").alias("storage_bytes"),
        F.coalesce(F.max("run"), F.lit("Never")).alias("last_run"),
    ).withColumn("storage", human_size(F.col("storage_bytes")))


def list_runs(files: DataFrame) -> DataFrame:
    """Runs, newest first; hidden directories are not runs."""
    return (files.select("run").where(~F.col("run").startswith(".")).distinct()
            .orderBy(F.col("run").desc()))


def runs_page(runs: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """One page of runs, newest first."""
    return runs.orderBy(F.col("run").desc()).offset(offset).limit(limit)


def list_archives(archives: DataFrame) -> DataFrame:
    return archives.orderBy(F.col("filename").desc())


def archives_with_namespace(archives: DataFrame, files: DataFrame, ns: str) -> DataFrame:
    """Archives of the runs that hold files of a namespace."""
    of = files.where(F.col("ns") == ns).select("run").distinct()
    return archives.join(of, "run", "left_semi")


def distinct_namespaces(files: DataFrame, run: str | None = None) -> DataFrame:
    if run is not None:
        files = files.where(F.col("run") == run)
    return files.where(F.col("ns") != "").select("ns").distinct().orderBy("ns")


def upsert_archives(archives: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest row per archive name; ``max_by`` combines map-side, so a hot name stays cheap."""
    rest = [c for c in archives.columns if c not in ("filename", "created_at")]
    return (archives.unionByName(changes)
            .groupBy("filename")
            .agg(F.max_by(F.struct(*rest), "created_at").alias("_row"),
                 F.max("created_at").alias("created_at"))
            .select("filename", "_row.*", "created_at"))


def remove_runs(table: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of a catalog table whose run is not among ``dropped``."""
    if "run" not in table.columns:
        table = table.withColumn("run", archive_run(F.col("filename")))
    return table.join(dropped.select("run"), "run", "left_anti")


def with_run_timestamp(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run_ts", run_timestamp(F.col("run")))


def write_index(files: DataFrame, files_path: str, runs_path: str,
                created_at: Column | None = None) -> None:
    """Replace the catalog partitions of the runs in ``files`` and leave other runs alone.

    Keyed by run, so writing the same run again leaves no orphans and a retried batch is harmless.
    The file rows are kept while both tables are written, so that lines are read once.
    """
    files = files.persist()
    try:
        runs = (with_run_timestamp(index_runs(files))
                .withColumn("created_at", F.current_timestamp() if created_at is None else created_at))
        for table, path in ((files, files_path), (runs, runs_path)):
            (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("run").parquet(path))
    finally:
        files.unpersist()


LEVEL_COUNT_COLUMNS = [f"{name}_count" for name in LEVELS]
