"""Selections of files and the timestamp-ordered merge of many sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.levels import level_in_merge
from ..functions.names import source_label
from ..functions.text import sort_key
from ..schemas import SELECTION, SOURCE_GROUPS
from .ordinals import CHUNK, KEY, ROWS_PER_CHUNK, number_lines, tail_lines
from .sizes import keep_small
from .zones import merge_by_zones

def make_selection(spark: SparkSession, runs: Sequence[str], files: Sequence[str]) -> DataFrame:
    """Parallel lists to an ordered selection; lists of different length are an error."""
    if not runs or len(runs) != len(files):
        raise ValueError("run and file lists must be non-empty and of equal length")
    rows = [(i, run, name) for i, (run, name) in enumerate(zip(runs, files))]
    return spark.createDataFrame(rows, SELECTION)


PRUNED_NAMES = 1_000


def pruned(lines: DataFrame, selection: DataFrame) -> DataFrame:
    """``lines`` cut to the runs and file names of a selection by literals, which prune partitions and row groups.

    A selection is a list of chosen files. At most ``PRUNED_NAMES`` pairs are looked at on the driver; a longer one
    is left to the join alone.
    """
    rows = selection.select("run", "filename").limit(PRUNED_NAMES + 1).collect()
    if len(rows) > PRUNED_NAMES:
        return lines
    runs, files = (sorted({r[i] for r in rows if r[i] is not None}) for i in (0, 1))
    return lines.where(F.col("run").isin(runs) & F.col("filename").isin(files))


def selected_lines(lines: DataFrame, selection: DataFrame) -> DataFrame:
    """Lines of the selected files, once per selection entry; missing files give nothing."""
    selection = keep_small(selection)
    return pruned(lines, selection).join(selection, ["run", "filename"])


def export_lines(lines: DataFrame, selection: DataFrame) -> DataFrame:
    """Lines of the selected files, each file once."""
    chosen = keep_small(selection.select("run", "filename").distinct())
    return pruned(lines, chosen).join(chosen, ["run", "filename"], "left_semi")


def merge_sources(lines: DataFrame, selection: DataFrame, tail: int | None = None,
                  order: Sequence[str] = ("line_no",), carry_forward: bool = False) -> DataFrame:
    """All lines of every selected source, or its last ``tail`` ones, tagged for the merge.

    Adds ``label``, ``ts_key``, ``level``, ``source_group`` and ``line_no``. Sort by ``ts_key, sel_idx, line_no``:
    that is a range-partitioned sort. ``carry_forward`` gives a line without a timestamp the
    one of the line before it, so that stack traces stay with their parent.
    """
    chosen = selected_lines(lines, selection)
    source = ["sel_idx", "run", "filename"]
    if tail is not None:
        chosen = tail_lines(chosen, tail, source, order)
    elif "line_no" not in chosen.columns:
        chosen = number_lines(chosen, source, order).drop("start_byte")
    chosen = chosen.withColumn("ts_key", sort_key(F.col("line")))
    if carry_forward:
        chosen = carry_timestamps(chosen, source)
    return chosen.withColumns({"label": source_label(F.col("filename")),
                               "level": level_in_merge(F.col("line")),
                               "source_group": F.pmod(F.col("sel_idx"), F.lit(SOURCE_GROUPS))})


def carry_timestamps(lines: DataFrame, keys: Sequence[str],
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Replace an empty ``ts_key`` by the last one before it in the same file.

    Works on fixed runs of ``line_no``: each passes its last key on to the following ones.
    """
    cut = lines.withColumns({KEY: F.struct(*keys),
                             CHUNK: F.floor((F.col("line_no") - 1) / rows_per_chunk),
                             "_key": F.nullif(F.col("ts_key"), F.lit(""))})
    last = cut.groupBy(KEY, CHUNK).agg(
        F.max_by("_key", F.when(F.col("_key").isNotNull(), F.col("line_no"))).alias("_last"))
    before = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(KEY, CHUNK, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    here = (Window.partitionBy(KEY, CHUNK).orderBy("line_no")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = cut.withColumn("_own", F.last("_key", ignorenulls=True).over(here))
    return (own.join(carried, [KEY, CHUNK])
            .withColumn("ts_key", F.coalesce("_own", "_carried", F.lit("")))
            .drop(KEY, CHUNK, "_key", "_own", "_carried"))


def merge_order(merged: DataFrame) -> DataFrame:
    """The merged view itself, as a distributed sort."""
    return merged.orderBy("ts_key", "sel_idx", "line_no")


def merge_positions(merged: DataFrame, rows_bound: int | None = None,
                    rows_per_chunk: int | None = None) -> DataFrame:
    """Explicit 1-based position in the merge.

    With a proven bound (selection size times tail) of at most a chunk, one window is enough; a merge that turns out
    larger is an error. Otherwise ranges are cut by the zone map of the lines.
    """
    order = ["ts_key", "sel_idx", "line_no"]
    if rows_bound is not None and rows_bound <= ROWS_PER_CHUNK:
        pos = F.row_number().over(Window.orderBy(*order)).cast("bigint")
        too_many = F.raise_error(F.lit(f"the merge has more than the {rows_bound} rows promised")).cast("bigint")
        return merged.withColumn("pos", F.when(pos <= rows_bound, pos).otherwise(too_many))
    return merge_by_zones(merged, ["sel_idx"], rows_per_zone=rows_per_chunk, rows_per_range=rows_per_chunk)


def merge_summary(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("total_lines"),
                      F.countDistinct("sel_idx").alias("sources"))


def visible_lines(merged: DataFrame, query: str) -> DataFrame:
    """Live filter of the merged view: the query is looked for in ``[label] line``."""
    if not query:
        return merged
    shown = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("line"))
    return merged.where(F.lower(shown).contains(F.lower(F.lit(query))))
