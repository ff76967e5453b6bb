"""Line and file filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_by_substring, level_counts, matches_level
from ..functions.text import contains_text, like_text
from .ordinals import head_lines


def filter_level(lines: DataFrame, level: str | None) -> DataFrame:
    """Lines with the level word; ``all``, None and unknown levels keep every line."""
    predicate = matches_level(F.col("line"), level)
    return lines if predicate is None else lines.where(predicate)


def filter_text(lines: DataFrame, query: str | None) -> DataFrame:
    return lines if not query else lines.where(contains_text(F.col("line"), query))


def filter_lines(lines: DataFrame, level: str | None = None, query: str | None = None) -> DataFrame:
    return filter_text(filter_level(lines, level), query)


def shown_line_counts(lines: DataFrame, level: str | None = None, query: str | None = None,
                      keys: Sequence[str] = ("run", "filename")) -> DataFrame:
    """Lines left per file after the filters; files with none left count 0."""
    shown = F.lit(True)
    predicate = matches_level(F.col("line"), level)
    if predicate is not None:
        shown = shown & predicate
    if query:
        shown = shown & contains_text(F.col("line"), query)
    return lines.groupBy(*keys).agg(F.count_if(shown).alias("shown_lines"))


def viewer_level_counts(lines: DataFrame, sample: int, keys: Sequence[str] = ("run", "filename"),
                        order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Level counts of the first ``sample`` lines per file, before any filter."""
    levels = head_lines(lines, sample, keys, order).withColumn("level", level_by_substring(F.col("line")))
    return levels.groupBy(*keys).agg(*level_counts(F.col("level")))


def search_lines(lines: DataFrame, query: str, namespaces: Sequence[str] | None = None,
                 run_from: str | None = None, run_to: str | None = None) -> DataFrame:
    """Full-text line search across runs; run and namespace predicates prune partitions."""
    if namespaces:
        lines = lines.where(F.col("ns").isin(list(namespaces)))
    if run_from:
        lines = lines.where(F.col("run") >= run_from)
    if run_to:
        lines = lines.where(F.col("run") <= run_to + "_99-99-99")
    return filter_text(lines, query)


def files_in_namespace(files: DataFrame, ns: str | None) -> DataFrame:
    return files if not ns else files.where(F.col("ns") == ns)


def files_with_ns_prefix(files: DataFrame, ns: str | None) -> DataFrame:
    return files if not ns else files.where(F.col("filename").startswith(ns + "__"))


def files_named(files: DataFrame, query: str | None, like: bool = False) -> DataFrame:
    if not query:
        return files
    match = like_text if like else contains_text
    return files.where(match(F.col("filename"), query))


def files_of_run(files: DataFrame, run: str, query: str | None = None, like: bool = False) -> DataFrame:
    """Files of one run by name; a run that does not exist gives no rows."""
    return files_named(files.where(F.col("run") == run), query, like).orderBy("filename")


def files_with_problems(files: DataFrame) -> DataFrame:
    return files.where((F.col("error_count") > 0) | (F.col("warn_count") > 0))


def files_modified_since(files: DataFrame, last_epoch: int, tolerance_s: int) -> DataFrame:
    """Files whose ``mtime`` (epoch seconds) is after the last run, less a clock-skew tolerance."""
    return files.where(F.col("mtime") > max(0, last_epoch - tolerance_s))


def pattern_count_by_run(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.groupBy("run").agg(F.count_if(F.col("line").contains(pattern)).alias("matches"))
