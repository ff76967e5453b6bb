"""Catalog search across runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text, like_text
from .filters import files_in_namespace, files_named

RESULT = ["run", "filename", "ns", "pod", "container", "size_bytes", "line_count",
          "error_count", "warn_count", "info_count", "debug_count"]


def files_in_runs(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files with the totals of their run; files of a run that is not catalogued drop out.

    No join hint: the run side is broadcast only when its measured size allows it.
    """
    return files.join(runs.select("run", "file_count", "total_bytes"), "run")


def in_date_range(runs: DataFrame, date_from: str | None, date_to: str | None) -> DataFrame:
    """Inclusive range on run names, which sort by time; prunes ``run`` partitions."""
    if date_from:
        runs = runs.where(F.col("run") >= date_from)
    if date_to:
        runs = runs.where(F.col("run") <= date_to + "_99-99-99")
    return runs


def search(files: DataFrame, runs: DataFrame, pod: str = "", ns: str = "", date_from: str = "",
           date_to: str = "", like: bool = False) -> DataFrame:
    """Every catalogued file that meets all given filters; no filter at all finds nothing.

    The date range is applied to both sides of the join, so both prune. For the capped,
    ordered report pass the result to ``top_results``.
    """
    pod, ns, date_from, date_to = (v.strip() for v in (pod, ns, date_from, date_to))
    if not (pod or ns or date_from or date_to):
        return files.select(*RESULT).limit(0)
    found = files_in_namespace(in_date_range(files, date_from, date_to), ns)
    if pod:
        match = like_text if like else contains_text
        hits = [match(F.col(c), pod) for c in ("pod", "ns", "filename")]
        found = found.where(reduce(lambda a, b: a | b, hits))
    known = in_date_range(runs, date_from, date_to).select("run")
    return found.join(known, "run").select(*RESULT)


def top_results(found: DataFrame, limit: int) -> DataFrame:
    """The report: newest run first, then file name, at most ``limit`` rows."""
    return found.orderBy(F.col("run").desc(), F.col("filename").asc()).limit(limit)


def sort_results(found: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """User-chosen order on the typed column, with a fixed tie-break."""
    key = F.col(column).desc() if descending else F.col(column).asc()
    return found.orderBy(key, "run", "filename")


def search_recent_runs(files: DataFrame, query: str = "", ns: str = "", date_from: str = "",
                       date_to: str = "", max_runs: int | None = None) -> DataFrame:
    """Search without an index: file names only, in the range, or in the newest ``max_runs`` runs of it."""
    ranged = in_date_range(files, date_from, date_to)
    found = files_named(files_in_namespace(ranged, ns), query)
    if max_runs is None:
        return found
    recent = ranged.select("run").distinct().orderBy(F.col("run").desc()).limit(max_runs)
    return found.join(recent, "run", "left_semi")
