"""Age- and capacity-based retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RETENTION_MONTH_DAYS
from .sizes import keep_small


def expired_runs(runs: DataFrame, now: Column, months: int = 1, mtime: str = "created_at") -> DataFrame:
    """Runs older than ``months`` of thirty days."""
    cutoff = now - F.make_dt_interval(F.lit(months * RETENTION_MONTH_DAYS))
    return runs.where(~F.col("run").startswith(".") & (F.col(mtime) < cutoff))


def cleanup_counts(dead_offsets: DataFrame, expired: DataFrame) -> DataFrame:
    """How many saved offsets have lost their file, and how many runs are past their age; none counts as 0."""
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
             for kind, rows in (("dead_offsets", dead_offsets), ("expired_runs", expired))]
    return parts[0].unionAll(parts[1])


def retention_next(runs: DataFrame, now: Column, months: int = 1, mtime: str = "created_at",
                   max_drop: int = 1) -> DataFrame:
    """The runs one retention cycle drops: the oldest expired ones, a single one by default.

    The newest run of all stays, however old it is.
    """
    newest = runs.where(~F.col("run").startswith(".")).agg(F.max("run").alias("run"))
    old = expired_runs(runs, now, months, mtime).join(newest, "run", "left_anti")
    return old.orderBy(mtime, "run").limit(max_drop)


def storage_usage(files: DataFrame, archives: DataFrame, capacity: Column) -> DataFrame:
    """Bytes held by files and archives, and the whole percentage of ``capacity`` they fill.

    ``capacity`` may refer to ``used_bytes``.
    """
    held = files.select("size_bytes").unionByName(archives.select("size_bytes"))
    return (held.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("used_bytes"))
            .withColumn("capacity_bytes", capacity.cast("bigint"))
            .withColumn("used_pct", F.when(
                F.col("capacity_bytes") > 0,
                F.floor(F.col("used_bytes") / F.col("capacity_bytes") * 100)
            ).otherwise(F.lit(0)).cast("bigint")))


def stored_sizes(listed: DataFrame, path: str = "path") -> DataFrame:
    """Bytes on storage per run, from a listing of tables partitioned by run; those outside any run under ``''``."""
    run = F.regexp_extract(path, r"/run=([^/]+)/", 1)
    return listed.groupBy(run.alias("run")).agg(F.sum("size_bytes").alias("size_bytes"))


def run_sizes(runs: DataFrame, archives: DataFrame) -> DataFrame:
    """Bytes freed by dropping each run: its files and its archives."""
    held = (runs.select("run", F.col("total_bytes").alias("size_bytes"), F.lit(True).alias("is_run"))
            .unionByName(archives.select("run", "size_bytes", F.lit(False).alias("is_run"))))
    return held.groupBy("run").agg(F.sum("size_bytes").alias("size_bytes"),
                                   F.max("is_run").alias("is_run")).where("is_run").drop("is_run")


def capacity_cleanup(sizes: DataFrame, threshold: Column, current_run: str | None = None) -> DataFrame:
    """Mark the oldest runs to drop while usage is at or above ``threshold``.

    ``sizes`` has ``run`` and ``size_bytes``; bytes that belong to no run have an empty one: they count, and
    dropping runs does not free them. ``threshold`` may refer to ``total_bytes``, and a
    null threshold disables the cleanup. The current run (the newest by default) always stays.
    Adds ``used_before`` (usage when it is the run's turn) and ``dropped``.

    Closed form of the drop loop: a run goes when everything older is gone and usage is still
    too high. Prefix sums are taken per day first and then over days, so the ordered windows
    hold at most one row per second of a day and one row per day.
    """
    sizes = keep_small(sizes.select("run", "size_bytes"))
    # The current run frees nothing. The newest run needs no such care: nothing comes after it.
    freed = F.when(F.col("run") == "", 0).otherwise(F.col("size_bytes"))
    if current_run is not None:
        freed = F.when(F.col("run") == current_run, 0).otherwise(freed)
    dated = sizes.withColumns({"_day": F.substring("run", 1, 10), "_freed": freed})
    days = dated.groupBy("_day").agg(F.sum("size_bytes").alias("_bytes"), F.sum("_freed").alias("_freed"),
                                     F.max("run").alias("_last"))
    by_day = Window.orderBy("_day")
    older_days = by_day.rowsBetween(Window.unboundedPreceding, -1)
    all_days = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = days.select(
        "_day", F.coalesce(F.sum("_freed").over(older_days), F.lit(0)).alias("_older_days"),
        F.sum("_bytes").over(all_days).alias("total_bytes"),
        F.max("_last").over(all_days).alias("_newest"))
    same_day = Window.partitionBy("_day").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    current = F.col("_newest") if current_run is None else F.lit(current_run)
    older = F.col("_older_days") + F.coalesce(F.col("_same_day"), F.lit(0))
    return (dated.withColumn("_same_day", F.sum("_freed").over(same_day))
            .join(days, "_day")
            .withColumn("used_before", F.col("total_bytes") - older)
            .withColumn("dropped", F.coalesce(
                (F.col("used_before") >= threshold) & (F.col("run") != current) & (F.col("run") != ""), F.lit(False)))
            .select("run", "size_bytes", "used_before", "dropped"))


def capacity_threshold(capacity: Column, percent: int) -> Column:
    """Byte threshold of a percentage; null (cleanup off) when the percentage is not positive."""
    if percent <= 0:
        return F.lit(None).cast("bigint")
    return F.floor(capacity.cast("double") * percent / 100).cast("bigint")
