"""One collection cycle from end to end: collect, index, archive, clean up."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import output_name
from ..functions.text import line_bytes, sort_key
from ..operators import incremental, retention
from ..operators.ordinals import number_lines
from ..schemas import API_OVERLAP_S, CONTAINER, LOG_LINES
from ..sources import archives, sinks, state, tables
from ..sources.text_tree import list_files, list_node_files
from .pipelines import start_ingest, store_run


class Store:
    """Where a deployment keeps its tables: one folder on shared storage."""

    def __init__(self, root: str):
        self.root = root
        self.lines, self.files, self.runs = f"{root}/lines", f"{root}/files", f"{root}/runs"
        self.archives, self.archive_data = f"{root}/archives", f"{root}/archive_data"
        self.checkpoint, self.last_run = f"{root}/checkpoint", f"{root}/last_run"

    @property
    def by_run(self) -> list[str]:
        stored = archives.Archive(self.archive_data)  # the index goes first: no row may lead to an object that is gone
        return [self.lines, self.files, self.runs, self.archives, stored.index, stored.data]


class ApiPhase:
    """Landed answers of the log API: lines (ns, pod, container, ts, line, seq) of current and of previous instances,
    and the inventory (ns, pod, containers) of what runs. ``seq`` is a line's number in its container's answer."""

    def __init__(self, lines: DataFrame, previous: DataFrame, inventory: DataFrame, overlap_s: int = API_OVERLAP_S):
        self.lines, self.previous, self.inventory, self.overlap_s = lines, previous, inventory, overlap_s


def node_coverage(spark: SparkSession, logs: str, last: datetime | None) -> DataFrame:
    """Containers with log files on the node, and whether one of their files was rotated since the last cycle."""
    recent = F.lit(True) if last is None else F.col("mtime") > F.lit(last)
    rotated = list_node_files(spark, logs, rotated=True).select(*CONTAINER, recent.alias("rotated"))
    active = list_node_files(spark, logs).select(*CONTAINER, F.lit(False).alias("rotated"))
    return active.unionAll(rotated).groupBy(*CONTAINER).agg(F.max("rotated").alias("rotated"))


def api_log_lines(spark: SparkSession, logs: str, store: Store, api: ApiPhase, run: str, last: datetime | None,
                  now: datetime) -> DataFrame:
    """What the API adds to a run, as ``log_lines``: current lines of containers the node does not have, less what earlier
    runs hold of the overlap, and the previous instance of containers whose file was rotated."""
    coverage = node_coverage(spark, logs, last)
    containers = incremental.explode_inventory(api.inventory)
    asked = incremental.lines_of(api.lines, incremental.uncovered(containers, coverage))
    since = None if last is None else F.lit(last)
    current = incremental.since_window(asked, F.lit(now), since, api.overlap_s)
    if last is not None:
        known = tables.log_lines(spark, store.lines).where(
            (F.col("run") != run) & (F.col("ts") >= F.lit(last) - F.make_dt_interval(secs=F.lit(api.overlap_s))))
        held = known.groupBy(*CONTAINER, "ts", "line").agg(F.count(F.lit(1)).alias("held"))
        nth = Window.partitionBy(*CONTAINER, "ts", "line").orderBy("seq")
        current = (current.withColumn("nth", F.row_number().over(nth)).join(held, [*CONTAINER, "ts", "line"], "left")
                   .where(F.col("nth") > F.coalesce("held", F.lit(0))).drop("nth", "held"))
    previous = incremental.lines_of(api.previous, incremental.previous_only(containers, coverage))
    parts = [lines.select(*CONTAINER, "ts", "line", "seq", output_name(*[F.col(c) for c in CONTAINER], F.lit(run),
                                                                       previous=old).alias("filename"))
             for lines, old in ((current, False), (previous, True))]
    both = parts[0].unionByName(parts[1]).withColumns({
        "run": F.lit(run), "uid": F.lit(""), "n_bytes": line_bytes(F.col("line")), "ts_key": sort_key(F.col("line"))})
    numbered = number_lines(both, ["run", "filename"], ["seq"], F.col("n_bytes") + 1)
    return numbered.select(*LOG_LINES.fieldNames())


def collect(spark: SparkSession, logs: str, store: Store, api: ApiPhase | None = None, now: datetime | None = None,
            **options) -> str | None:
    """Read what is new under ``logs``, and what the API adds to it, into one run; returns its name, None if all is known.

    The time of the cycle is saved when all of it is stored.
    """
    now = now or datetime.now(timezone.utc)
    last = state.read_last_run(spark, store.last_run)
    more = None if api is None else lambda run: api_log_lines(spark, logs, store, api, run, last, now)
    written: list[str] = []
    start_ingest(spark, logs, store.lines, store.files, store.runs, store.checkpoint,
                 now=True, more=more, written=written, **options).awaitTermination()
    if not written and more is not None:
        run = now.astimezone(timezone.utc).strftime("%Y-%m-%d_%H-%M-%S")
        lines = more(run)
        if not lines.isEmpty():
            store_run(lines, run, store.lines, store.files, store.runs)
            written.append(run)
    state.write_last_run(spark, store.last_run, now)
    return written[0] if written else None


def archive_new_runs(spark: SparkSession, store: Store) -> list[str]:
    """Archive every run that has no archive yet: the latest one, unless a cycle was cut short."""
    done = tables.archives(spark, store.archives).select("run")
    missing = tables.runs(spark, store.runs).select("run").join(done, "run", "left_anti").orderBy("run")
    names = [r.run for r in missing.collect()]
    if names:
        archived = archives.write_archives(tables.log_lines(spark, store.lines), names, store.archive_data)
        sinks.write_archives(archived, store.archives)
    return names


def reopen(spark: SparkSession, store: Store, runs: Sequence[str] | None = None, filenames: Sequence[str] | None = None) -> DataFrame:
    """Lines of archived runs or files, whether their runs are still stored or not."""
    return archives.read_archived(spark, store.archive_data, runs, filenames)


def clean_up(spark: SparkSession, store: Store, now: datetime, months: int = 1, max_drop: int = 1,
             capacity_bytes: int | None = None, capacity_percent: int = 80) -> list[str]:
    """Drop runs until usage is below the threshold, then the oldest expired ones.

    Usage is what the store's files take on storage, whether they belong to a run or not. The newest run always stays. Dropping a run removes its lines, catalog rows and archive.
    """
    dropped = []
    if capacity_bytes is not None:
        sizes = retention.stored_sizes(list_files(spark, store.root))
        threshold = retention.capacity_threshold(F.lit(capacity_bytes), capacity_percent)
        over = retention.capacity_cleanup(sizes, threshold).where("dropped").orderBy("run")
        dropped += [r.run for r in over.select("run").collect()]
        sinks.drop_runs(spark, dropped, *store.by_run)
    expired = retention.retention_next(tables.runs(spark, store.runs), F.lit(now), months, max_drop=max_drop)
    aged = [r.run for r in expired.select("run").collect()]
    sinks.drop_runs(spark, aged, *store.by_run)
    return dropped + aged
