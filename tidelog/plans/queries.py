"""Every registered query. Each one reads its whole input table and is checked by a SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import levels, names, text, times
from ..operators import (catalog, export, filters, incremental, merge, ordinals, retention,
                         search, text_index, zones)
from ..operators.sizes import keep_small
from ..schemas import CONTAINER, LOG_LINES
from ..sources import archives
from ..sources.folders import shared_folder
from ..sources.run_store import RunStore
from ..sources.state import offsets_from_json
from ..streaming.level_windows import counted_windows, daily
from ..streaming.pipelines import tumbling_level_counts
from . import adapters as src

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the SQL twins.
SAMPLE = 5
RUN = "2024-01-02_00-00-00"
NS = "ns2"
POD_TEXT = "POD-1"
LIKE_TEXT = "POD_1%SIDE"
LINE_TEXT = '"k": 6'
WORD_TEXT = "ÜBER"
DATE_FROM, DATE_TO = "2024-01-05", "2024-01-10"
BOUNDARY = "2024-01-15 00:00:00"
NOW = "2024-02-10 00:00:00"
PART_BYTES = 4_096
MTIME_TOLERANCE_S = 300
RECENT_RUNS = 30

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _ranked(df: DataFrame, *order) -> DataFrame:
    """Explicit rank of an already limited report."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _index(spark: SparkSession, sf: str, run_from: str | None = None, run_to: str | None = None) -> DataFrame:
    return src.indexed_files(spark, sf, None, run_from, run_to)


FILE_COLUMNS = ["run", "filename", "ns", "pod", "container", "size_bytes"]
LINE_COLUMNS = ["run", "filename", "event_id", "line"]


# ---- line filters ------------------------------------------------------------------------

@query
def filter_level_error(spark, sf):
    return filters.filter_level(src.event_lines(spark, sf), "error").select(*LINE_COLUMNS)


@query
def filter_level_warning(spark, sf):
    return filters.filter_level(src.event_lines(spark, sf), "warning").select(*LINE_COLUMNS)


@query
def filter_level_info(spark, sf):
    return filters.filter_level(src.event_lines(spark, sf), "info").select(*LINE_COLUMNS)


@query
def filter_level_debug(spark, sf):
    return filters.filter_level(src.event_lines(spark, sf), "debug").select(*LINE_COLUMNS)


@query
def filter_level_all(spark, sf):
    return filters.filter_level(src.event_lines(spark, sf), "all").select(*LINE_COLUMNS)


@query
def filter_text(spark, sf):
    return filters.filter_text(src.event_lines(spark, sf), LINE_TEXT).select(*LINE_COLUMNS)


@query
def filter_level_and_text(spark, sf):
    return filters.filter_lines(src.event_lines(spark, sf), "error", LINE_TEXT).select(*LINE_COLUMNS)


@query
def search_lines(spark, sf):
    lines = src.event_lines(spark, sf, DATE_FROM, DATE_TO)
    return filters.search_lines(lines, LINE_TEXT, [NS, "ns3"], DATE_FROM, DATE_TO).select(*LINE_COLUMNS)


@query
def search_document_lines(spark, sf):
    found = filters.search_lines(src.doc_lines(spark, sf), "É")
    return found.select("ns", "doc_id", "line_no", "line")


def _indexed(spark, lines, block):
    """The lines stored with a filter, as an ingest would leave them."""
    store = text_index.IndexedLines(shared_folder(spark), lines.schema)
    text_index.write_indexed_lines(lines, store, block)
    return store


@query
def search_lines_indexed(spark, sf):
    store = _indexed(spark, src.event_lines(spark, sf), ["filename", F.shiftright("event_id", 12)])
    found = text_index.search_indexed_lines(spark, store, LINE_TEXT, [NS, "ns3"], DATE_FROM, DATE_TO)
    return found.select(*LINE_COLUMNS)


@query
def search_document_lines_indexed(spark, sf):
    lines = src.doc_lines(spark, sf).withColumn("run", F.col("ns"))
    store = _indexed(spark, lines, [F.shiftright("doc_id", 6)])
    found = text_index.search_indexed_lines(spark, store, WORD_TEXT)
    return found.select("ns", "doc_id", "line_no", "line")


@query
def search_no_filter(spark, sf):
    return _searched(spark, sf)


@query
def shown_line_count(spark, sf):
    lines = src.event_lines(spark, sf, RUN, RUN).where(F.col("run") == RUN)
    return filters.shown_line_counts(lines, "error", "user=1")


@query
def viewer_level_counts(spark, sf):
    lines = src.event_lines(spark, sf, RUN, RUN).where(F.col("run") == RUN)
    return filters.viewer_level_counts(lines, SAMPLE, order=src.ORDER)


@query
def pattern_count_by_run(spark, sf):
    return filters.pattern_count_by_run(src.event_lines(spark, sf), "user=1")


# ---- file filters ------------------------------------------------------------------------

@query
def files_by_namespace(spark, sf):
    return filters.files_in_namespace(src.log_files(spark, sf), NS).select(*FILE_COLUMNS)


@query
def files_by_ns_prefix(spark, sf):
    return filters.files_with_ns_prefix(src.log_files(spark, sf), NS).select(*FILE_COLUMNS)


@query
def files_by_name(spark, sf):
    return filters.files_named(src.log_files(spark, sf), POD_TEXT).select(*FILE_COLUMNS)


@query
def run_files(spark, sf):
    return filters.files_of_run(src.log_files(spark, sf, RUN, RUN), RUN).select(*FILE_COLUMNS)


@query
def run_files_like(spark, sf):
    files = src.log_files(spark, sf, RUN, RUN)
    return filters.files_of_run(files, RUN, LIKE_TEXT, like=True).select(*FILE_COLUMNS)


@query
def files_with_problems(spark, sf):
    return filters.files_with_problems(_index(spark, sf)).select(
        "run", "filename", "error_count", "warn_count")


@query
def files_modified_since(spark, sf):
    files = src.log_files(spark, sf, mtime=True)
    seconds = F.floor(times.epoch_micros(F.col("mtime"), "timestamp_ntz") / 1_000_000)
    files = files.withColumn("mtime", seconds)
    last = int(datetime.fromisoformat(BOUNDARY).replace(tzinfo=timezone.utc).timestamp())
    return filters.files_modified_since(files, last, MTIME_TOLERANCE_S).select(*FILE_COLUMNS)


# ---- catalog -----------------------------------------------------------------------------

@query
def file_line_counts(spark, sf):
    return src.log_files(spark, sf).select("run", "filename", "line_count")


@query
def file_level_counts(spark, sf):
    """The levels of each file's first lines, whose number is the feature."""
    return src.indexed_files(spark, sf, SAMPLE).select(
        "run", "filename", "line_count", *catalog.LEVEL_COUNT_COLUMNS)


@query
def file_level_counts_exact(spark, sf):
    return _index(spark, sf).select("run", "filename", "line_count", *catalog.LEVEL_COUNT_COLUMNS)


@query
def index_run(spark, sf):
    return _index(spark, sf, RUN, RUN).where(F.col("run") == RUN).select(*search.RESULT)


@query
def run_totals(spark, sf):
    return src.runs(spark, sf)


@query
def run_count(spark, sf):
    kinds = (src.runs(spark, sf).select(F.lit("runs").alias("kind"))
             .unionAll(src.archives(spark, sf).select(F.lit("archives").alias("kind"))))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def dashboard_stats(spark, sf):
    return catalog.dashboard_stats(src.runs(spark, sf), src.archives(spark, sf))


@query
def distinct_namespaces(spark, sf):
    return catalog.distinct_namespaces(src.event_lines(spark, sf))


@query
def run_namespaces(spark, sf):
    return catalog.distinct_namespaces(src.event_lines(spark, sf, RUN, RUN), RUN)


@query
def list_runs(spark, sf):
    return catalog.list_runs(src.event_lines(spark, sf))


@query
def runs_page(spark, sf):
    page = catalog.runs_page(src.runs(spark, sf), limit=10, offset=5)
    return _ranked(page, F.col("run").desc()).withColumn("rank", F.col("rank") + 5)


@query
def list_archives(spark, sf):
    return catalog.list_archives(src.archives(spark, sf)).select("filename", "size_bytes")


@query
def archive_upsert(spark, sf):
    known = src.archives(spark, sf).withColumn("created_at", F.lit(1.0))
    again = src.runs(spark, sf).select(
        names.archive_name(F.col("run")).alias("filename"), "run",
        F.floor(F.col("total_bytes") / 5).cast("bigint").alias("size_bytes"),
        F.when(F.col("run") < DATE_TO, 2.0).otherwise(0.5).alias("created_at"))
    return catalog.upsert_archives(known, again)


@query
def remove_run(spark, sf):
    runs = src.runs(spark, sf)
    dropped = retention.expired_runs(runs.withColumn("mtime", names.run_timestamp(F.col("run"))),
                                     F.to_timestamp(F.lit(NOW)), mtime="mtime")
    none = F.lit("")
    kept = [catalog.remove_runs(runs, dropped).select(F.lit("runs").alias("kept_in"), "run", none.alias("filename")),
            catalog.remove_runs(src.log_files(spark, sf), dropped).select(
                F.lit("log_files").alias("kept_in"), "run", "filename"),
            catalog.remove_runs(src.archives(spark, sf).drop("run"), dropped).select(
                F.lit("archives").alias("kept_in"), "run", "filename")]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query
def archive_run_match(spark, sf):
    archives = src.archives(spark, sf).select("filename", names.archive_run(F.col("filename")).alias("run"))
    return archives.join(src.runs(spark, sf), "run").select("filename", "run", "total_bytes")


@query
def run_with_archive(spark, sf):
    archives = src.archives(spark, sf).select("filename", F.col("size_bytes").alias("archive_bytes"))
    named = src.runs(spark, sf).withColumn("filename", names.archive_name(F.col("run")))
    joined = named.join(archives, "filename", "left")
    return joined.select("run", "total_bytes", F.col("archive_bytes").isNotNull().alias("has_archive"),
                         F.coalesce("archive_bytes", F.lit(0)).alias("archive_bytes"))


@query
def archives_by_namespace(spark, sf):
    found = catalog.archives_with_namespace(src.archives(spark, sf), src.event_lines(spark, sf), NS)
    return found.select("filename", "run", "size_bytes")


# ---- search ------------------------------------------------------------------------------

@query
def search_join(spark, sf):
    files = src.log_files(spark, sf)
    return search.files_in_runs(files, catalog.index_runs(files)).select(
        "run", "filename", "size_bytes", "file_count", "total_bytes")


def _searched(spark, sf, run_from=None, run_to=None, **wanted):
    return search.search(_index(spark, sf, run_from, run_to), src.runs(spark, sf, run_from, run_to), **wanted)


@query
def search_pod(spark, sf):
    return _searched(spark, sf, pod=POD_TEXT)


@query
def search_pod_like(spark, sf):
    return _searched(spark, sf, pod=LIKE_TEXT, like=True)


@query
def search_date_range(spark, sf):
    return _searched(spark, sf, DATE_FROM, DATE_TO, date_from=DATE_FROM, date_to=DATE_TO)


@query
def search_all_filters(spark, sf):
    return _searched(spark, sf, DATE_FROM, DATE_TO, pod=POD_TEXT, ns=NS, date_from=DATE_FROM, date_to=DATE_TO)


@query
def search_count(spark, sf):
    return _searched(spark, sf, pod=POD_TEXT).agg(F.count(F.lit(1)).alias("results"))


@query
def search_top500(spark, sf):
    top = search.top_results(_searched(spark, sf, date_from="2024"), 500)
    return _ranked(top, F.col("run").desc(), "filename")


@query
def search_sorted_by_size(spark, sf):
    return search.sort_results(_searched(spark, sf, pod=POD_TEXT), "size_bytes", descending=True)


@query
def search_recent_runs(spark, sf):
    found = search.search_recent_runs(src.log_files(spark, sf), query=POD_TEXT, ns=NS, max_runs=RECENT_RUNS)
    return found.select(*FILE_COLUMNS)


# ---- head, tail, merge, export -----------------------------------------------------------

@query
def head_n_per_file(spark, sf):
    lines = ordinals.head_lines(src.event_lines(spark, sf), SAMPLE, order=src.ORDER)
    return lines.select("run", "filename", "line_no", "event_id", "line")


@query
def tail_n_per_file(spark, sf):
    lines = ordinals.tail_lines(src.event_lines(spark, sf), SAMPLE, order=src.ORDER)
    return lines.select("run", "filename", "line_no", "event_id", "line")


@query
def line_positions(spark, sf):
    numbered = ordinals.number_lines(src.event_lines(spark, sf), ["run", "filename"], src.ORDER,
                                     F.col("n_bytes") + 1, bounds=src.event_bounds(spark, sf))
    return numbered.select("run", "filename", "event_id", "line_no", "start_byte")


def _selected(spark, sf):
    """All lines, and a selection that reaches over two runs."""
    return src.event_lines(spark, sf), src.selection(spark, sf, RUN)


def _merged(spark, sf):
    lines, chosen = _selected(spark, sf)
    return merge.merge_sources(lines, chosen, SAMPLE, src.ORDER)


@query
def merge_view(spark, sf):
    merged = merge.merge_positions(_merged(spark, sf), src.SELECTION_ROWS * SAMPLE)
    return merged.select("pos", "sel_idx", "source_group", "label", "ts_key", "level", "line_no", "line")


@query
def merge_whole_files(spark, sf):
    lines, chosen = _selected(spark, sf)
    merged = merge.merge_sources(lines, chosen, None, src.ORDER)
    merged = merge.merge_positions(merged)
    return merged.select("pos", "sel_idx", "ts_key", "line_no", "line")


@query
def merge_all_files(spark, sf):
    """Every line of every run in the order of time."""
    numbered = ordinals.number_lines(src.event_lines(spark, sf), ["run", "filename"], src.ORDER, bounds=src.event_bounds(spark, sf))
    merged = zones.merge_by_zones(numbered.withColumn("ts_key", text.sort_key(F.col("line"))), ["run", "filename"])
    return merged.select("pos", "run", "filename", "line_no", "line")


@query
def merge_summary(spark, sf):
    return merge.merge_summary(_merged(spark, sf))


@query
def merged_filter_count(spark, sf):
    visible = merge.visible_lines(_merged(spark, sf), "] 2024-01-02T2")
    return visible.agg(F.count(F.lit(1)).alias("visible"))


@query
def selection_join(spark, sf):
    lines, chosen = _selected(spark, sf)
    return merge.selected_lines(lines, chosen).select("sel_idx", *LINE_COLUMNS)


@query
def export_selection(spark, sf):
    lines, chosen = _selected(spark, sf)
    return merge.export_lines(lines, chosen).select(*LINE_COLUMNS)


@query
def doc_lines(spark, sf):
    return src.doc_lines(spark, sf)


def _parts(spark, sf):
    return export.split_parts(src.positioned_doc_lines(spark, sf), PART_BYTES)


@query
def split_parts(spark, sf):
    return _parts(spark, sf).select("ns", "doc_id", "line_no", "start_byte", "n_bytes", "part")


@query
def split_parts_summary(spark, sf):
    return export.part_summary(_parts(spark, sf), ["ns"])


@query
def part_names(spark, sf):
    return _parts(spark, sf).select("ns", "part").distinct().select(
        "ns", "part", names.part_filename(F.concat("ns", F.lit("__all__text.log")), F.col("part")).alias("out_name"))


def _log_lines(spark, sf):
    """The event lines as ``log_lines``, positions included."""
    numbered = ordinals.number_lines(src.event_lines(spark, sf), ["run", "filename"], src.ORDER,
                                     F.col("n_bytes") + 1, bounds=src.event_bounds(spark, sf))
    return numbered.withColumns({"uid": F.lit(""), "ts_key": text.sort_key(F.col("line")), "ts": F.col("ts").cast("timestamp")}).select(
        *LOG_LINES.fieldNames())


@query
def archive_read_back(spark, sf):
    """Every run is archived and read back from its archive."""
    lines, path = _log_lines(spark, sf), shared_folder(spark)
    archives.write_archives(lines, [r.run for r in catalog.list_runs(src.event_lines(spark, sf)).collect()], path)
    return archives.read_archived(spark, path).select("run", "filename", "line_no", "start_byte", "n_bytes", "line")


@query
def committed_files(spark, sf):
    """The catalog of a run store after two writes, the second of which replaces the runs of the first one."""
    store, lines = RunStore(spark, shared_folder(spark)), _log_lines(spark, sf)
    store.put(lines.where(F.col("run") <= DATE_TO))
    store.put(lines)
    return store.files().select("run", "filename", "size_bytes", "line_count", *catalog.LEVEL_COUNT_COLUMNS)


@query
def nonempty_outputs(spark, sf):
    errors = filters.filter_lines(src.event_lines(spark, sf), "error", LINE_TEXT)
    blank = F.when(src.pod_number() % 4 == 0, 0).otherwise(F.col("n_bytes"))
    return export.nonempty_outputs(errors.withColumn("n_bytes", blank), ["run", "filename"])


# ---- incremental collection --------------------------------------------------------------

@query
def offset_lookup(spark, sf):
    return incremental.with_offsets(src.log_files(spark, sf), src.offsets(spark, sf)).select(
        "filename", "size_bytes", "byte_offset")


@query
def rotation_detect(spark, sf):
    return incremental.with_offsets(src.log_files(spark, sf), src.offsets(spark, sf)).select(
        "filename", "byte_offset", "effective_offset", "rotated")


@query
def new_bytes(spark, sf):
    return incremental.with_offsets(src.log_files(spark, sf), src.offsets(spark, sf)).select(
        "filename", "new_bytes")


@query
def files_with_new_data(spark, sf):
    return incremental.files_with_new_data(src.log_files(spark, sf), src.offsets(spark, sf)).select(
        "filename", "size_bytes", "byte_offset")


@query
def incremental_lines(spark, sf):
    fresh = incremental.incremental_lines(src.event_lines(spark, sf), src.log_files(spark, sf),
                                          src.offsets(spark, sf), src.ORDER, bounds=src.event_bounds(spark, sf))
    return fresh.select("filename", "line_no", "start_byte", "line")


@query
def next_offsets(spark, sf):
    return incremental.next_offsets(src.log_files(spark, sf))


@query
def dead_offsets(spark, sf):
    return incremental.dead_offsets(src.offsets(spark, sf), src.log_files(spark, sf))


@query
def offsets_explode(spark, sf):
    saved = src.offsets(spark, sf)
    stored = saved.select(F.to_json(F.create_map("path", "byte_offset")).alias("value"))
    corrupt = saved.select(F.concat(F.lit("{"), F.col("path")).alias("value"))
    return offsets_from_json(stored.unionAll(corrupt))


@query
def rotated_skip_bytes(spark, sf):
    active = src.offsets(spark, sf)
    parts = names.filename_parts(F.col("path"))
    active = active.select(*[parts[c].alias(c) for c in [*CONTAINER, "run"]], "byte_offset").where(
        F.col("run") == "2024-01-05_00-00-00")
    skips = incremental.rotated_skip_bytes(src.rotated_files(spark, sf), active, F.lit("2024-01-03_00-00-00"))
    return skips.select(*CONTAINER, "name", "size_bytes", "skip_bytes")


def _containers(spark, sf):
    return incremental.explode_inventory(src.inventory(spark, sf))


@query
def inventory_explode(spark, sf):
    return _containers(spark, sf)


@query
def api_candidates(spark, sf):
    return incremental.api_candidates(_containers(spark, sf), src.coverage(spark, sf))


@query
def api_skip_existing(spark, sf):
    outputs = src.log_files(spark, sf, RUN, RUN).where(F.col("run") == RUN)
    return incremental.without_output(_containers(spark, sf), outputs)


@query
def previous_only_lines(spark, sf):
    keys = incremental.previous_only(_containers(spark, sf), src.coverage(spark, sf))
    lines = incremental.lines_of(src.event_lines(spark, sf), keys)
    out = names.output_name(*[F.col(c) for c in CONTAINER], F.col("run"), previous=True)
    return lines.select(out.alias("out_name"), "event_id", "line")


@query
def api_since_window(spark, sf):
    lines = incremental.since_window(src.api_lines(spark, sf), src.ntz(NOW), src.ntz(BOUNDARY))
    return lines.select("batch", *CONTAINER, "line")


@query
def overlap_dedup(spark, sf):
    return incremental.drop_overlap(src.api_lines(spark, sf)).select(*CONTAINER, "line")


@query
def union_rotated_active(spark, sf):
    active = src.log_files(spark, sf).where(F.col("run") >= src.ROTATED_BEFORE).select(
        *CONTAINER, F.lit("0.log").alias("name"), "size_bytes")
    both = incremental.union_rotated_active(src.rotated_files(spark, sf).drop("mtime"), active)
    return both.groupBy(*CONTAINER, "src_rank", "name").agg(F.sum("size_bytes").alias("size_bytes"))


def _phases(spark, sf):
    coverage, containers = keep_small(src.coverage(spark, sf)), keep_small(_containers(spark, sf))
    lines = src.event_lines(spark, sf).select(*CONTAINER, "line")
    return incremental.union_phases(
        incremental.lines_of(lines, coverage),
        incremental.lines_of(lines, incremental.uncovered(containers, coverage)),
        incremental.lines_of(lines, incremental.previous_only(containers, coverage)))


@query
def union_phases(spark, sf):
    return _phases(spark, sf).select("phase", *CONTAINER, "line")


@query
def phase_counts(spark, sf):
    return incremental.phase_counts(_phases(spark, sf))


# ---- retention ---------------------------------------------------------------------------

def _aged_runs(spark, sf):
    return src.runs(spark, sf).withColumn("mtime", names.run_timestamp(F.col("run")))


@query
def expired_runs(spark, sf):
    return retention.expired_runs(_aged_runs(spark, sf), F.to_timestamp(F.lit(NOW)), mtime="mtime").select(
        "run", "total_bytes")


@query
def cleanup_counts(spark, sf):
    dead = incremental.dead_offsets(src.offsets(spark, sf), src.log_files(spark, sf))
    expired = retention.expired_runs(_aged_runs(spark, sf), F.to_timestamp(F.lit(NOW)), mtime="mtime")
    return retention.cleanup_counts(dead, expired)


@query
def retention_next(spark, sf):
    return retention.retention_next(_aged_runs(spark, sf), F.to_timestamp(F.lit(NOW)), mtime="mtime").select(
        "run", "total_bytes")


@query
def storage_usage(spark, sf):
    return retention.storage_usage(src.log_files(spark, sf), src.archives(spark, sf), F.col("used_bytes") * 3)


@query
def capacity_cleanup(spark, sf):
    sizes = retention.run_sizes(src.runs(spark, sf), src.archives(spark, sf))
    return retention.capacity_cleanup(sizes, retention.capacity_threshold(F.col("total_bytes") * 2, 20))


# ---- scalar functions --------------------------------------------------------------------

@query
def parse_filename(spark, sf):
    files = src.event_lines(spark, sf).select("ns", "pod", "container", "filename").distinct()
    odd = F.explode(F.array(
        F.col("filename"), F.concat("ns", F.lit("__"), "pod", F.lit(".log")), F.concat("ns", F.lit(".log")),
        F.concat("ns", F.lit("__a__"), "pod", F.lit("___"), "container", F.lit(".part2.log"))))
    named = files.select(odd.alias("filename")).distinct()
    parts = names.filename_parts(F.col("filename"))
    return named.select("filename", *[c.alias(k) for k, c in parts.items()])


@query
def parse_pod_dir(spark, sf):
    dirs = src.event_lines(spark, sf).select("ns", "pod", "container").distinct().select(
        F.explode(F.array(F.concat("ns", F.lit("_"), "pod", F.lit("_uid-"), "container"),
                          F.concat("ns", F.lit("_"), "pod"), F.col("ns"))).alias("dir")).distinct()
    parts = names.pod_dir_parts(F.col("dir"))
    return dirs.where(names.is_pod_dir(F.col("dir"))).select("dir", *[c.alias(k) for k, c in parts.items()])


@query
def container_key(spark, sf):
    return src.event_lines(spark, sf).select(
        names.container_key(F.col("ns"), F.col("pod"), F.col("container")).alias("container_key")).distinct()


@query
def source_labels(spark, sf):
    files = src.event_lines(spark, sf).select("ns", "filename").distinct()
    short = F.explode(F.array(F.col("filename"), F.concat("ns", F.lit("__single.log"))))
    return files.select(short.alias("filename")).distinct().select(
        "filename", names.source_label(F.col("filename")).alias("label"),
        names.display_name(F.col("filename")).alias("display_name"))


@query
def human_size(spark, sf):
    sizes = src.log_files(spark, sf).select(
        "filename", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("power"), "size_bytes")
    scaled = sizes.withColumn("size_bytes", (F.col("size_bytes") * F.pow(F.lit(1024.0), "power")).cast("bigint"))
    return scaled.select("filename", "size_bytes", text.human_size(F.col("size_bytes")).alias("size"))


@query
def level_substring(spark, sf):
    return src.event_lines(spark, sf).select("event_id", levels.level_by_substring(F.col("line")).alias("level"))


@query
def level_merged(spark, sf):
    return src.event_lines(spark, sf).select("event_id", levels.level_in_merge(F.col("line")).alias("level"))


@query
def level_regex(spark, sf):
    return src.event_lines(spark, sf).select("event_id", levels.level_by_word(F.col("line")).alias("level"))


@query
def extract_ts(spark, sf):
    key = text.sort_key(F.col("line")).alias("ts_key")
    return (src.event_lines(spark, sf).select(F.lit("events").alias("origin"), F.col("event_id").alias("id"),
                                              F.lit(1).cast("bigint").alias("line_no"), key)
            .unionAll(src.doc_lines(spark, sf).select(F.lit("documents"), "doc_id", "line_no", key)))


@query
def archive_dates(spark, sf):
    run = names.archive_run(F.col("filename"))
    return src.archives(spark, sf).select("filename", run.alias("run"), names.run_date_label(run).alias("label"))


@query
def run_bucket(spark, sf):
    return src.events(spark, sf).select("event_id", names.run_name(F.col("ts")).alias("run"))


# ---- batch twin of the streaming counts --------------------------------------------------

@query
def level_counts_tumbling(spark, sf):
    counts = tumbling_level_counts(src.event_lines(spark, sf), keys=["ns"])
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def level_counts_daily(spark, sf):
    """The daily totals that the stream of counts keeps: windows first, then days."""
    windows = counted_windows(src.event_lines(spark, sf), ["ns", "pod"])
    return daily(windows, ["ns", "pod"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
