"""A store of runs in which lines, files, runs and archives change together.

Every write goes to a folder of its own below ``attempts``. What readers see is a *version*: a table with a row per run
(its folder, totals and archive) and a one-row summary. A version counts once its marker is there, which is the last thing
written, so a reader finds either all of a change or nothing of it, whatever step a writer stopped at. Dropping a run
writes a version without it first. ``vacuum`` removes folders that no kept version refers to.

The summary is carried from version to version by what a change adds and takes away, so the dashboard is one stored row.
There is one writer at a time: the ingest.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import run_timestamp
from ..functions.text import human_size
from ..operators.catalog import index_files
from ..schemas import ARCHIVES, LOG_FILES, LOG_LINES, RUNS
from .folders import delete_folder, list_folders, mark_folder

VERSIONS_KEPT = 2
MARKER = "COMMITTED"
ENTRY = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("folder", T.StringType()),
    T.StructField("file_count", T.LongType()), T.StructField("total_bytes", T.LongType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("archive", T.StringType()),
    T.StructField("archive_bytes", T.LongType()), T.StructField("archived_at", T.TimestampType())])
COUNTS = ["runs", "files", "zips", "storage_bytes"]
SUMMARY = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("last_run", T.StringType())])


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions, self.attempts = spark, f"{root}/versions", f"{root}/attempts"

    # -- readers --------------------------------------------------------------------------

    def version(self) -> str | None:
        """Folder of the newest version; None if nothing was ever committed."""
        names = [n for n in list_folders(self.spark, self.versions) if MARKER in list_folders(self.spark, f"{self.versions}/{n}")]
        return f"{self.versions}/{names[-1]}" if names else None

    def entries(self, version: str | None = None) -> DataFrame:
        version = version or self.version()
        return self.spark.read.schema(ENTRY).parquet(f"{version}/runs") if version else self.spark.createDataFrame([], ENTRY)

    def runs(self) -> DataFrame:
        return self.entries().withColumn("run_ts", run_timestamp(F.col("run"))).select(*RUNS.fieldNames())

    def archives(self) -> DataFrame:
        return self.entries().where(F.col("archive").isNotNull()).select(
            F.col("archive").alias("filename"), "run", F.col("archive_bytes").alias("size_bytes"),
            F.col("archived_at").alias("created_at")).select(*ARCHIVES.fieldNames())

    def lines(self, run_from: str | None = None, run_to: str | None = None) -> DataFrame:
        return self._read("lines", LOG_LINES, run_from, run_to)

    def files(self, run_from: str | None = None, run_to: str | None = None) -> DataFrame:
        return self._read("files", LOG_FILES, run_from, run_to)

    def _read(self, table: str, schema: T.StructType, run_from: str | None, run_to: str | None) -> DataFrame:
        """Folders of the wanted runs alone are listed: their names are a row per run."""
        found = self.entries()
        if run_from:
            found = found.where(F.col("run") >= run_from)
        if run_to:
            found = found.where(F.col("run") <= run_to + "_99-99-99")
        paths = sorted(f"{r.folder}/{table}/run_dir={r.run}" for r in found.select("run", "folder").collect())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def dashboard_stats(self) -> DataFrame:
        """The stored summary: one row, however many runs there are."""
        version = self.version()
        row = self.spark.read.schema(SUMMARY).parquet(f"{version}/summary") if version else self.spark.createDataFrame(
            [(0, 0, 0, 0, None)], SUMMARY)
        return row.withColumn("last_run", F.coalesce("last_run", F.lit("Never"))).withColumn("storage", human_size(F.col("storage_bytes")))

    # -- writers --------------------------------------------------------------------------

    def put(self, lines: DataFrame, sample: int | None = None) -> list[str]:
        """Add or replace the runs in ``lines``, with their catalog rows, in one version. Returns their names."""
        folder = f"{self.attempts}/{uuid.uuid4().hex}"
        (lines.select(*LOG_LINES.fieldNames(), F.col("run").alias("run_dir")).hint("rebalance", "run_dir", "ns")
         .sortWithinPartitions("run_dir", "ns", "filename", "line_no").write.partitionBy("run_dir").parquet(f"{folder}/lines"))
        written = self.spark.read.schema(LOG_LINES).parquet(f"{folder}/lines")
        files = index_files(written, sample).select(*LOG_FILES.fieldNames(), F.col("run").alias("run_dir"))
        files.write.partitionBy("run_dir").parquet(f"{folder}/files")
        totals = (self.spark.read.schema(LOG_FILES).parquet(f"{folder}/files").groupBy("run")
                  .agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")))
        entries = totals.select("run", F.lit(folder).alias("folder"), "file_count", "total_bytes", F.current_timestamp().alias("created_at"),
                                *[F.lit(None).cast(ENTRY[c].dataType).alias(c) for c in ("archive", "archive_bytes", "archived_at")])
        return self._commit(entries.collect(), [])  # a row per run of this write

    def drop(self, runs: Sequence[str]) -> None:
        """Drop runs, with their files and archives, in one version."""
        self._commit([], list(runs))

    def set_archives(self, archives: DataFrame) -> None:
        """Note the archives of stored runs, given as ``archives`` rows; those of other runs are left out."""
        given = archives.select("run", "filename", "size_bytes", F.col("created_at").alias("at"))
        changed = self.entries().join(given, "run").select(
            "run", "folder", "file_count", "total_bytes", "created_at", F.col("filename").alias("archive"),
            F.col("size_bytes").alias("archive_bytes"), F.col("at").alias("archived_at"))
        self._commit(changed.collect(), [])  # a row per archive of this write

    def _commit(self, put: list, dropped: list[str]) -> list[str]:
        version = self.version()
        names = sorted(r.run for r in put)
        gone = sorted({*names, *dropped})
        if not gone:
            return []
        old = self.entries(version)
        before = old.where(F.col("run").isin(gone)).collect()
        entries = old.where(~F.col("run").isin(gone)).unionByName(self.spark.createDataFrame(put, ENTRY))
        target = f"{self.versions}/v{self._number(version) + 1:012d}"
        delete_folder(self.spark, target)  # left by a writer that was stopped
        entries.coalesce(1).write.parquet(f"{target}/runs")
        summary = self._summary(version)
        for sign, rows in ((-1, before), (1, put)):
            for r in rows:
                for c, n in zip(COUNTS, (1, r.file_count, int(r.archive is not None), r.total_bytes + (r.archive_bytes or 0))):
                    summary[c] += sign * n
        if summary["last_run"] in gone and summary["last_run"] not in names:
            summary["last_run"] = self.spark.read.schema(ENTRY).parquet(f"{target}/runs").agg(F.max("run")).first()[0]
        elif names:
            summary["last_run"] = max(names[-1], summary["last_run"] or "")
        self.spark.createDataFrame([tuple(summary.values())], SUMMARY).coalesce(1).write.parquet(f"{target}/summary")
        self._mark(target)
        return names

    @staticmethod
    def _number(version: str | None) -> int:
        return int(version.rpartition("/v")[2]) if version else 0

    def _summary(self, version: str | None) -> dict:
        row = self.spark.read.schema(SUMMARY).parquet(f"{version}/summary").first() if version else None
        return row.asDict() if row else dict.fromkeys(COUNTS, 0) | {"last_run": None}

    def _mark(self, version: str) -> None:
        mark_folder(self.spark, f"{version}/{MARKER}")

    def vacuum(self, keep: int = VERSIONS_KEPT) -> list[str]:
        """Remove all but the newest versions, and attempts that none of them refers to. Not while a run is written."""
        newest = self.version()
        if newest is None:
            return []
        names = list_folders(self.spark, self.versions)
        done = [n for n in names if n <= newest.rpartition("/")[2]]
        marked = [n for n in done if MARKER in list_folders(self.spark, f"{self.versions}/{n}")][-keep:]
        used = {r.folder for n in marked for r in self.entries(f"{self.versions}/{n}").select("folder").distinct().collect()}
        removed = [f"{self.versions}/{n}" for n in names if n not in marked]
        removed += [f"{self.attempts}/{a}" for a in list_folders(self.spark, self.attempts) if f"{self.attempts}/{a}" not in used]
        for folder in removed:
            delete_folder(self.spark, folder)
        return removed
