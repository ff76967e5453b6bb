"""Level counts per event-time window, kept by a stream, with a tolerance for late lines.

A batch's counts are added to the *open* windows. The watermark is the newest event time seen less the tolerance; a day
that it has passed is closed: its windows and its total go to a folder of their own and are not touched again. Lines of
a closed day are late: their counts wait in a side table, which readers add and ``merge_late`` folds into the days.

Every change is a *version* (open windows, late counts, a row per closed day), which counts once its marker is there. A
batch's version carries its number, so a batch that is tried again changes nothing, at whatever step it stopped. What a
read costs depends on the days asked for and on the open windows, not on how many batches there were.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.levels import LEVELS, level_by_substring, level_counts
from ..sources.folders import delete_folder, list_folders, mark_folder

WINDOW = "4 hours"
TOLERANCE = "2 days"
MARKER = "COMMITTED"
COUNTS = [f"{level}_count" for level in LEVELS]
DAYS = "day date, folder string"
STATE = "batch bigint, watermark timestamp, closed_until timestamp, late_lines bigint"
EMPTY_STATE = (-1, None, None, 0)


def counted_windows(lines: DataFrame, keys: Sequence[str], width: str = WINDOW) -> DataFrame:
    """Level counts, lines and newest time per window and source. Lines without a time belong to no window."""
    levelled = lines.withColumn("_level", level_by_substring(F.col("line")))
    return (levelled.groupBy(F.window("ts", width).alias("_window"), *keys)
            .agg(*level_counts(F.col("_level")), F.count(F.lit(1)).alias("lines"), F.max("ts").cast("timestamp").alias("newest"))
            .select(F.col("_window.start").cast("timestamp").alias("window_start"), *keys, *COUNTS, "lines", "newest"))


def daily(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per day and source from counts per window. A window belongs to the day in which it starts."""
    return (windows.groupBy(F.to_date("window_start").alias("day"), *keys)
            .agg(*[F.sum(c).alias(c) for c in COUNTS]))


class LevelWindows:
    """``keys`` are string columns of the lines; ``width`` should divide a day."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("ns", "pod"), width: str = WINDOW,
                 tolerance: str = TOLERANCE):
        self.spark, self.keys, self.width, self.tolerance = spark, list(keys), width, tolerance
        self.versions, self.closed = f"{root}/versions", f"{root}/days"
        fields = [T.StructField("window_start", T.TimestampType()), *(T.StructField(k, T.StringType()) for k in keys),
                  *(T.StructField(c, T.LongType()) for c in COUNTS)]
        self.schema = T.StructType(fields)

    # -- readers --------------------------------------------------------------------------

    def windows(self, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
        """Counts per window and source, of all lines so far. Folders of other days are not listed."""
        version = self._newest()
        loose = self._in_days(self._part(version, "open").unionAll(self._part(version, "late")), day_from, day_to)
        return self._added(loose.unionAll(self._days(version, "windows", self.schema, day_from, day_to)))

    def days(self, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
        """Counts per day and source. A closed day is read from its total, a row per source."""
        version = self._newest()
        schema = T.StructType([T.StructField("day", T.DateType()), *self.schema.fields[1:]])
        loose = self._in_days(self._part(version, "open").unionAll(self._part(version, "late")), day_from, day_to)
        both = daily(loose, self.keys).select(*schema.fieldNames()).unionAll(
            self._days(version, "total", schema, day_from, day_to))
        return both.groupBy("day", *self.keys).agg(*[F.sum(c).alias(c) for c in COUNTS])

    def state(self) -> dict:
        """Number of the last batch, watermark, start of the first open day, and how many late lines there were so far."""
        return self._state(self._newest())

    def _part(self, version: str | None, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{version}/{name}") if version else self.spark.createDataFrame([], self.schema)

    def _days(self, version: str | None, name: str, schema: T.StructType, day_from: str | None, day_to: str | None) -> DataFrame:
        folders = []
        if version:
            chosen = self._manifest(version)
            chosen = chosen.where(F.col("day") >= F.lit(day_from).cast("date")) if day_from else chosen
            chosen = chosen.where(F.col("day") <= F.lit(day_to).cast("date")) if day_to else chosen
            folders = sorted(f"{r.folder}/{name}/at={r.day}" for r in chosen.collect())  # a row per day
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _manifest(self, version: str) -> DataFrame:
        return self.spark.read.schema(DAYS).parquet(f"{version}/days")

    def _state(self, version: str | None) -> dict:
        names = ["batch", "watermark", "closed_until", "late_lines"]
        row = self.spark.read.schema(STATE).parquet(f"{version}/state").first() if version else EMPTY_STATE
        return dict(zip(names, row))

    @staticmethod
    def _in_days(rows: DataFrame, day_from: str | None, day_to: str | None) -> DataFrame:
        day = F.to_date("window_start")
        rows = rows.where(day >= F.lit(day_from).cast("date")) if day_from else rows
        return rows.where(day <= F.lit(day_to).cast("date")) if day_to else rows

    def _added(self, rows: DataFrame) -> DataFrame:
        return (rows.groupBy("window_start", *self.keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
                .select(*self.schema.fieldNames()))

    # -- writers --------------------------------------------------------------------------

    def add(self, lines: DataFrame, number: int) -> bool:
        """Add a batch of lines; False if this batch is in already. Batches come in order of their numbers."""
        before = self._newest()
        known = self._state(before)
        if number <= known["batch"]:
            return False
        target = self._fresh(before)
        counts = counted_windows(lines, self.keys, self.width)
        counts.write.parquet(f"{target}/batch")  # lines are read once
        counts = self.spark.read.schema(counts.schema).parquet(f"{target}/batch")
        # A row: the watermark after this batch, and what of the batch was late by the one before it.
        closed = F.lit(known["closed_until"]).cast("timestamp")
        is_late = F.coalesce(F.col("window_start") < closed, F.lit(False))
        newest = F.max("newest") - F.expr(f"interval {self.tolerance}")
        watermark = F.greatest(newest, F.lit(known["watermark"]).cast("timestamp"))
        row = counts.agg(watermark.alias("watermark"), F.coalesce(F.sum(F.when(is_late, F.col("lines"))), F.lit(0)).alias("late")).first()
        until = counts.sparkSession.range(1).select(F.greatest(F.date_trunc("day", F.lit(row.watermark).cast("timestamp")), closed)).first()[0]
        counts = counts.select("*", is_late.alias("is_late"))
        fields = self.schema.fieldNames()
        self._added(self._part(before, "open").unionAll(counts.where(~F.col("is_late")).select(*fields))).write.parquet(f"{target}/all")
        everything = self.spark.read.schema(self.schema).parquet(f"{target}/all")
        done = F.coalesce(F.col("window_start") < F.lit(until).cast("timestamp"), F.lit(False))
        everything.where(~done).coalesce(1).write.parquet(f"{target}/open")
        late = self._part(before, "late").unionAll(counts.where("is_late").select(*fields))
        self._added(late).coalesce(1).write.parquet(f"{target}/late")
        self._finish(before, target, everything.where(done), (number, row.watermark, until, known["late_lines"] + row.late))
        return True

    def merge_late(self) -> None:
        """Fold the late counts into their days, in one version. Only those days are written again."""
        before = self._newest()
        if before is None or self._part(before, "late").isEmpty():
            return
        target = self._fresh(before)
        late = self._part(before, "late")
        touched = sorted(str(r[0]) for r in late.select(F.to_date("window_start")).distinct().collect())  # days
        folders = {str(r.day): r.folder for r in self._manifest(before).collect()}
        held = [f"{folders[d]}/windows/at={d}" for d in touched if d in folders]
        whole = late.unionAll(self.spark.read.schema(self.schema).parquet(*held)) if held else late
        self._part(before, "open").coalesce(1).write.parquet(f"{target}/open")
        late.limit(0).write.parquet(f"{target}/late")
        self._finish(before, target, self._added(whole), tuple(self._state(before).values()))

    def _finish(self, before: str | None, target: str, closing: DataFrame, state: tuple) -> None:
        """Write the days that ``closing`` holds, name their folder in the manifest, and mark the version."""
        folder = f"{self.closed}/{uuid.uuid4().hex}"
        at = F.to_date("window_start")
        closing.withColumn("at", at).repartition("at").write.partitionBy("at").parquet(f"{folder}/windows")
        names = [n.removeprefix("at=") for n in list_folders(self.spark, f"{folder}/windows") if n.startswith("at=")]
        if names:
            windows = self.spark.read.schema(self.schema).parquet(*[f"{folder}/windows/at={n}" for n in names])
            daily(windows, self.keys).withColumn("at", F.col("day")).repartition("at").write.partitionBy("at").parquet(f"{folder}/total")
        new = self.spark.createDataFrame([(n, folder) for n in names], "day string, folder string").select(F.col("day").cast("date"), "folder")
        old = self._manifest(before) if before else self.spark.createDataFrame([], DAYS)
        old.join(new.select("day"), "day", "left_anti").unionByName(new).coalesce(1).write.parquet(f"{target}/days")
        self.spark.createDataFrame([state], STATE).coalesce(1).write.parquet(f"{target}/state")
        mark_folder(self.spark, f"{target}/{MARKER}")

    def _newest(self) -> str | None:
        for name in reversed(list_folders(self.spark, self.versions)):
            if MARKER in list_folders(self.spark, f"{self.versions}/{name}"):
                return f"{self.versions}/{name}"
        return None

    def _fresh(self, before: str | None) -> str:
        number = int(before.rpartition("/v")[2]) + 1 if before else 0
        target = f"{self.versions}/v{number:012d}"
        delete_folder(self.spark, target)  # left by a writer that was stopped
        return target

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest versions, and folders of days that none of them names. Not while a batch is written."""
        names = list_folders(self.spark, self.versions)
        marked = [n for n in names if MARKER in list_folders(self.spark, f"{self.versions}/{n}")][-keep:]
        used = {r.folder for n in marked for r in self._manifest(f"{self.versions}/{n}").select("folder").distinct().collect()}
        removed = [f"{self.versions}/{n}" for n in names if n not in marked]
        removed += [f"{self.closed}/{n}" for n in list_folders(self.spark, self.closed) if f"{self.closed}/{n}" not in used]
        for folder in removed:
            delete_folder(self.spark, folder)
        return removed


def start_level_windows(lines: DataFrame, store: LevelWindows, checkpoint: str, merge_every: int = 24, **trigger) -> StreamingQuery:
    """Keep the counts of a stream of lines with ``ts``, ``line`` and the store's keys; ``trigger`` is that of the writer.

    Late counts are folded into their days, and what is no longer named is removed, after each ``merge_every`` batches.
    """
    def each(batch: DataFrame, number: int) -> None:
        if store.add(batch, number) and (number + 1) % merge_every == 0:
            store.merge_late()
            store.vacuum()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
