"""Streaming jobs: tail, landed files, de-duplication, ingest with catalog upkeep, level counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.levels import level_by_substring, level_counts
from ..functions.names import output_name, pod_dir_parts, utc_run_name
from ..functions.text import line_bytes, sort_key
from ..operators.catalog import index_files, write_index
from ..operators.ordinals import number_lines
from ..schemas import CONTAINER, LOG_LINES
from ..sources.run_store import RunStore
from ..sources.sinks import drop_runs, write_log_lines
from ..sources.tail import LogTailSource
from ..sources.text_tree import ROTATED_GLOB
from .intervals import drop_read_ranges

WINDOW = "4 hours"
EVER = "36500d"
LATENESS = "9 hours"  # two cycles and their overlap


def run_trigger(now: bool = False, every: str = WINDOW) -> dict:
    """Arguments for ``DataStreamWriter.trigger``: once over what is there, or on a schedule."""
    return {"availableNow": True} if now else {"processingTime": every}


def tail_stream(spark: SparkSession, root: str, **options) -> DataFrame:
    """New lines of growing log files under ``root``, which every executor must be able to read."""
    spark.dataSource.register(LogTailSource)
    return spark.readStream.format("log_tail").option("path", root).options(**options).load()


def landed_stream(spark: SparkSession, root: str, max_files: int = 1_000, max_age: str | None = None,
                  clean: str = "off", archive_dir: str | None = None) -> DataFrame:
    """Lines of rotated files, which never change once they have landed, with their container and file identity.

    Every file is read, however old, unless ``max_age`` says otherwise. A file is known by its path, so ``file_fp`` is a
    digest of path, size and time. ``range_start`` is where the piece of the file begins that a task read.
    """
    reader = (spark.readStream.format("text").option("pathGlobFilter", ROTATED_GLOB)
              .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
              .option("maxFileAge", max_age or EVER).option("cleanSource", clean))
    if archive_dir:
        reader = reader.option("sourceArchiveDir", archive_dir)
    path = F.col("_metadata.file_path")
    folder = pod_dir_parts(F.element_at(F.split(path, "/"), -3))
    return reader.load(root).select(
        *[folder[c].alias(c) for c in ("ns", "pod", "uid")], F.element_at(F.split(path, "/"), -2).alias("container"),
        path.alias("path"), F.md5(F.concat_ws(":", path, F.col("_metadata.file_size").cast("string"), F.unix_micros(
            F.col("_metadata.file_modification_time")).cast("string"))).alias("file_fp"),
        F.col("_metadata.file_block_start").alias("range_start"), line_bytes(F.col("value")).alias("n_bytes"),
        F.col("value").alias("line"), F.current_timestamp().alias("collected_at"))


def drop_reread_lines(tail: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One copy of every node line, however often its bytes were read.

    ``lateness`` is time of collection, not of the log: it bounds how long a file is remembered after its last new line.
    The state is the byte intervals of each file, not its lines.
    """
    return drop_read_ranges(tail, lateness)


def drop_stream_overlap(api_lines: DataFrame, keys: Sequence[str] = CONTAINER, lateness: str = LATENESS) -> DataFrame:
    """One copy of every API line that overlapping fetches returned.

    ``collected_at`` is when a fetch was made. Lines are remembered for ``lateness`` of that, which must cover a cycle
    and its overlap; how old the lines are does not matter. Genuine repeats within a fetch stay if the fetch numbered
    them in ``copy`` (``number_copies``).
    """
    copy = ["copy"] if "copy" in api_lines.columns else []
    return (api_lines.withWatermark("collected_at", lateness)
            .dropDuplicatesWithinWatermark([*keys, "ts", "line", *copy]))


def tumbling_level_counts(lines: DataFrame, keys: Sequence[str] = ("ns", "pod"),
                          width: str = WINDOW) -> DataFrame:
    """Level counts per source and tumbling window."""
    levelled = lines.withColumn("_level", level_by_substring(F.col("line")))
    return (levelled.groupBy(F.window("ts", width).alias("_window"), *keys)
            .agg(*level_counts(F.col("_level")))
            .select(F.col("_window.start").alias("window_start"), *keys,
                    "error_count", "warn_count", "info_count", "debug_count"))


def write_level_counts(lines: DataFrame, path: str, keys: Sequence[str] = ("ns", "pod"), width: str = WINDOW) -> None:
    """Replace the level counts of the runs in ``lines``. Counts of several runs add up, so a source that comes
    late adds to its window, and a batch that is tried again changes nothing."""
    (tumbling_level_counts(lines, ["run", *keys], width).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))


def stored_level_counts(spark: SparkSession, path: str, keys: Sequence[str] = ("ns", "pod")) -> DataFrame:
    """Level counts per source and window over all runs written so far."""
    counts = [F.sum(f"{level}_count").alias(f"{level}_count") for level in ("error", "warn", "info", "debug")]
    return spark.read.parquet(path).groupBy("window_start", *keys).agg(*counts)


def as_log_lines(batch: DataFrame) -> DataFrame:
    """Collected lines as ``log_lines`` of the run named after the batch's listing.

    The byte ranges the source read are the chunks for numbering.
    """
    run = utc_run_name(F.col("collected_at"))
    key = sort_key(F.col("line"))
    named = batch.withColumns({
        "run": run, "filename": output_name(*[F.col(c) for c in CONTAINER], run),
        "src_rank": F.when(F.col("path").contains(".log."), 0).otherwise(1),
        "src_byte": F.col("start_byte"), "ts_key": key, "ts": F.try_to_timestamp(key),
    }).drop("start_byte")
    numbered = number_lines(named, ["run", "filename"], ["src_byte"], F.col("n_bytes") + 1,
                            chunk=F.struct("src_rank", "path", "range_start"))
    return numbered.select(*LOG_LINES.fieldNames())


def ingest_batch(batch: DataFrame, lines_path: str, files_path: str, runs_path: str,
                 sample: int | None = None, counts_path: str | None = None,
                 more: Callable[[str], DataFrame] | None = None) -> str | None:
    """Write a batch's lines, index them from what was written, and count levels per window if asked to.

    ``more`` gives further ``log_lines`` for the run's name, which are written with it. Returns the name; None and
    nothing written if the batch is empty.

    A batch is one listing and therefore one run. Every table is replaced by run, and the run
    is fixed by the batch's offsets, so a batch that is tried again ends in the same tables.
    """
    any_line = batch.select(utc_run_name(F.col("collected_at")).alias("run")).first()  # a batch has one time of collection
    if any_line is None:
        return None
    lines = as_log_lines(batch)
    store_run(lines if more is None else lines.unionByName(more(any_line.run)), any_line.run, lines_path,
              files_path, runs_path, sample, counts_path)
    return any_line.run


def store_run(lines: DataFrame, run: str, lines_path: str, files_path: str, runs_path: str,
              sample: int | None = None, counts_path: str | None = None) -> None:
    """Write the lines of one run and index them from what was written."""
    drop_runs(lines.sparkSession, [run], lines_path)  # an earlier try may have seen namespaces that are gone
    write_log_lines(lines, lines_path)
    written = (lines.sparkSession.read.schema(LOG_LINES).option("basePath", lines_path)
               .parquet(f"{lines_path}/run={run}"))
    write_index(index_files(written, sample), files_path, runs_path)
    if counts_path:
        write_level_counts(written, counts_path)


def start_ingest(spark: SparkSession, root: str, lines_path: str, files_path: str, runs_path: str,
                 checkpoint: str, now: bool = False, every: str = WINDOW, counts_path: str | None = None,
                 reread_guard: str | None = None, more: Callable[[str], DataFrame] | None = None,
                 written: list[str] | None = None, **options) -> StreamingQuery:
    """Collect new lines on a schedule, or once, and keep the line table and catalog up to date.

    ``counts_path`` keeps level counts per window. ``reread_guard`` is a span of collection time within which bytes that
    are read again, say after a file was copied back, give no second line; it costs a few numbers of state per file.
    ``more`` adds lines to the first run that is written; ``written`` gets the names of the runs.
    """
    names = [] if written is None else written

    def each(batch: DataFrame, _: int) -> None:
        run = ingest_batch(batch, lines_path, files_path, runs_path, counts_path=counts_path,
                           more=None if names else more)
        if run is not None:
            names.append(run)

    lines = tail_stream(spark, root, **options)
    if reread_guard:
        lines = drop_reread_lines(lines, reread_guard)
    return (lines.writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(**run_trigger(now, every)).start())


def start_store_ingest(spark: SparkSession, root: str, store: RunStore, checkpoint: str, now: bool = False, every: str = WINDOW,
                       reread_guard: str | None = None, **options) -> StreamingQuery:
    """Collect new lines into a run store: a batch's lines and catalog rows become visible together, in one version.

    A batch that is tried again replaces its own run. Its lines are read once.
    """
    lines = tail_stream(spark, root, **options)
    if reread_guard:
        lines = drop_reread_lines(lines, reread_guard)
    return (lines.writeStream.foreachBatch(lambda batch, _: store.put(as_log_lines(batch)) and None)
            .option("checkpointLocation", checkpoint).trigger(**run_trigger(now, every)).start())
