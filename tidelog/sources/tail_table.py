"""Collection of growing log files whose listing, marks and reading are all done by tasks.

The streaming source ``log_tail`` keeps one listing in its offset and makes it in the driver; that is enough for some ten
thousand files. Here what is known of the files is a table: a row per container folder, written as a version that holds only
the folders that changed, and all folders every ``FULL_EVERY`` versions. The driver lists the pod folders and nothing below.

A version is planned, read and committed. Its plan (byte ranges and the state after them) is written first, so a collection
that stops anywhere goes on with the same ranges under the same run name, and the run store replaces that run.

``max_bytes`` bounds what one version reads; the rest waits for the next one. Folders take turns by version, so none waits
for ever. Within a folder rotated files come first. A plain file may be cut anywhere, a compressed one is read whole, so the
bound may be exceeded by one such file. As long as a folder is not read to its end, all its earlier positions are kept, for a
file that is renamed meanwhile is known again by them.

Rules of lines, renames, copies and compressed files are those of ``log_tail``. Files are opened by their path, which
every executor must be able to read.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folders import delete_folder, list_folders, mark_folder
from .run_store import RunStore
from .tail import (RANGE_BYTES, SCHEMA, ByteRange, LogTailReader, _compressed, _mark, _rotated, _subdirectories, file_ranges,
                   log_entries, seen_file)

FULL_EVERY = 16  # versions from one whole state to the next
TURNS = 1024  # groups of folders that take turns when a version is bounded
TASK_FILES = 2048  # ranges of small files to a task
PLANNED, COMMITTED, FULL = "PLANNED", "COMMITTED", "FULL"
LISTING = "pod_dir string, folder string, before string, found string, bytes bigint"
PLAN = "version bigint, pod_dir string, folder string, gone boolean, entries string, ranges array<string>, bytes bigint"


class TailTable:
    """Lines that were added to the log files below ``root`` since the last version in ``folder``, on shared storage."""

    def __init__(self, spark: SparkSession, root: str, folder: str, max_bytes: int | None = None,
                 range_bytes: int = RANGE_BYTES, fail_on_data_loss: bool = True):
        if max_bytes is not None and max_bytes < 1:
            raise ValueError("max_bytes must be positive")
        self.spark, self.root, self.folder = spark, root, folder
        self.max_bytes, self.range_bytes, self.fail_on_data_loss = max_bytes, range_bytes, fail_on_data_loss

    # -- versions -------------------------------------------------------------------------

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}"

    def _marks(self, version: int) -> list[str]:
        return list_folders(self.spark, self._path(version))

    def committed(self) -> int:
        """The newest committed version; 0 if there is none."""
        versions = [int(n[1:]) for n in list_folders(self.spark, self.folder)]
        return next((v for v in reversed(versions) if COMMITTED in self._marks(v)), 0)

    def _full(self, version: int) -> int:
        """The whole state that a version's goes back to."""
        return next((v for v in range(version, 0, -1) if FULL in self._marks(v)), 0)

    def state(self, version: int | None = None) -> DataFrame:
        """(pod_dir, folder, entries): what is known of each container folder after a version."""
        version = self.committed() if version is None else version
        paths = [f"{self._path(v)}/plan" for v in range(max(1, self._full(version)), version + 1)]
        rows = self.spark.read.schema(PLAN).parquet(*paths) if paths else self.spark.createDataFrame([], PLAN)
        last = rows.groupBy("pod_dir", "folder").agg(F.max_by(F.struct("gone", "entries"), "version").alias("last"))
        return last.where("NOT last.gone").select("pod_dir", "folder", F.col("last.entries").alias("entries"))

    # -- planning -------------------------------------------------------------------------

    def plan(self) -> tuple[int, int] | None:
        """The version to be read and its time, which names its run; None if nothing changed. A plan that was left is taken up."""
        done = self.committed()
        version, target = done + 1, self._path(done + 1)
        marks = self._marks(version)
        if PLANNED not in marks:
            delete_folder(self.spark, target)  # left by a planner that was stopped
            at = max([int(time.time()), *(self._at(self._marks(v)) + 1 for v in [done] if v)])
            if not self._write_plan(version, at):
                delete_folder(self.spark, target)
                return None
            mark_folder(self.spark, f"{target}/at={at}")
            mark_folder(self.spark, f"{target}/{PLANNED}")
            marks = self._marks(version)
        return version, self._at(marks)

    @staticmethod
    def _at(marks: list[str]) -> int:
        return next(int(m[3:]) for m in marks if m.startswith("at="))

    def _write_plan(self, version: int, at: int) -> bool:
        done, target = version - 1, self._path(version)
        full = done == 0 or version - self._full(done) >= FULL_EVERY
        self._listing(done, at, full).write.parquet(f"{target}/listing")
        listing = self.spark.read.schema(LISTING).parquet(f"{target}/listing")
        if self.max_bytes is None:
            turns = listing.withColumn("skip", F.lit(0).cast("bigint"))
        else:
            turns = self._in_turns(listing, version)
        most, range_bytes = self.max_bytes, self.range_bytes

        def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [admitted(r["folder"], json.loads(r["before"]), json.loads(r["found"]),
                                 None if most is None else max(0, most - r["skip"]), at, range_bytes) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(rows), pa.int64()), batch.column("pod_dir"), batch.column("folder"),
                     pa.array([not entries for entries, _ in rows], pa.bool_()),
                     pa.array([json.dumps(entries) for entries, _ in rows], pa.string()),
                     pa.array([[json.dumps(vars(r)) for r in ranges] for _, ranges in rows], pa.list_(pa.string())),
                     pa.array([sum(r.end - r.start for r in ranges) for _, ranges in rows], pa.int64())],
                    ["version", "pod_dir", "folder", "gone", "entries", "ranges", "bytes"])

        planned = turns.select("pod_dir", "folder", "before", "found", "skip").mapInArrow(admit, PLAN)
        planned.write.parquet(f"{target}/plan")
        if full:
            mark_folder(self.spark, f"{target}/{FULL}")
        return not listing.where("before <> found").isEmpty()

    def _listing(self, done: int, at: int, full: bool) -> DataFrame:
        """Container folders that changed (all with ``full``): what is known of them, what is there, bytes to be read.

        A task lists whole pod folders and is given what is known of them, which is as much as they hold.
        """
        pods = self.spark.createDataFrame([(p,) for p in _subdirectories(self.root) if "_" in os.path.basename(p)], "pod_dir string")
        known = self.state(done).groupBy("pod_dir").agg(F.collect_list(F.struct("folder", "entries")).alias("known"))
        range_bytes = self.range_bytes

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for pod in batch.to_pylist():
                    before = {k["folder"]: k["entries"] for k in pod["known"] or []}
                    for folder in sorted({*before, *_subdirectories(pod["pod_dir"])}):
                        old = before.get(folder, "[]")
                        found = listed(folder, json.loads(old), at)
                        now = json.dumps(found)
                        if full or now != old:
                            size = sum(r.end - r.start for e in found for r in ranges_of(e, json.loads(old), at, range_bytes))
                            if found or before.get(folder):
                                rows.append((pod["pod_dir"], folder, old, now, size))
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())],
                    ["pod_dir", "folder", "before", "found", "bytes"])

        # Dealt by folder: round robin would leave a few pods in one task.
        return pods.join(known, "pod_dir", "full").repartition("pod_dir").mapInArrow(look, LISTING)

    def _in_turns(self, listing: DataFrame, version: int) -> DataFrame:
        """Bytes that stand before each folder: sums per group, whose number is fixed, then within a group."""
        turn = F.pmod(F.xxhash64("folder") + F.lit(version * 389), F.lit(TURNS)).cast("int")
        rows = listing.withColumn("turn", turn)
        sums = rows.groupBy("turn").agg(F.sum("bytes").alias("group_bytes"))
        before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("turn", F.coalesce(F.sum("group_bytes").over(before), F.lit(0)).alias("group_skip"))
        within = Window.partitionBy("turn").orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("own_skip", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
        return rows.join(sums, "turn").withColumn("skip", F.col("group_skip") + F.col("own_skip"))

    # -- reading --------------------------------------------------------------------------

    def lines(self, version: int) -> DataFrame:
        """The lines of a planned version, as ``log_tail`` gives them."""
        plan = self.spark.read.schema(PLAN).parquet(f"{self._path(version)}/plan").where(F.size("ranges") > 0)
        size = plan.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                        F.coalesce(F.sum(F.size("ranges")), F.lit(0)).alias("ranges")).first()
        tasks = 1 + max(size["bytes"] // RANGE_BYTES, size["ranges"] // TASK_FILES)
        reader = LogTailReader({"path": self.root, "failOnDataLoss": str(self.fail_on_data_loss)})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text in batch.column("range").to_pylist():
                    yield from reader.read(as_range(json.loads(text)))

        ranges = plan.select(F.explode("ranges").alias("range"))
        return ranges.repartition(max(tasks, min(size["ranges"], self.spark.sparkContext.defaultParallelism)) or 1).mapInArrow(read, SCHEMA)

    def left(self, version: int) -> bool:
        """Whether the bound kept a planned version from reading all that was listed."""
        total = F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
        listed_bytes, planned_bytes = (self.spark.read.schema(schema).parquet(f"{self._path(version)}/{name}").agg(total).first()["bytes"]
                                       for name, schema in (("listing", LISTING), ("plan", PLAN)))
        return planned_bytes < listed_bytes

    def commit(self, version: int) -> None:
        """From here on what the version read is known. Versions that no state goes back to are removed."""
        mark_folder(self.spark, f"{self._path(version)}/{COMMITTED}")
        full = self._full(version)
        for name in list_folders(self.spark, self.folder):
            if int(name[1:]) < full:
                delete_folder(self.spark, f"{self.folder}/{name}")


# -- tasks: one container folder at a time ----------------------------------------------------
# An entry is [path, position, identity, mark, first seen, whole, time of change, kept only to know files again].


def listed(folder: str, before: list[list], at: int) -> list[list]:
    """Entries of the files of a folder as they are now. Files that did not change are not opened."""
    known = {e[0]: e for e in before if not e[7]}
    born = {e[2]: (e[1], e[4]) for e in before}
    out = []
    for path, stat in log_entries(folder):
        old = known.get(path)
        if old and old[5] and old[1:3] == [stat.st_size, _identity(stat)] and old[6] == stat.st_mtime_ns:
            out.append(old)
            continue
        found = seen_file(path)
        if found is not None:
            stat, mark = found
            size, first = born.get(_identity(stat), (0, at))
            out.append([path, stat.st_size, _identity(stat), mark, first if stat.st_size >= size else at, True, stat.st_mtime_ns, False])
    return out


def _identity(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def ranges_of(entry: list, before: list[list], at: int, range_bytes: int) -> list[ByteRange]:
    """What is new in a file, if anything is."""
    old = next((e for e in before if e[0] == entry[0] and not e[7]), None)
    if old and old[1:4] == entry[1:4] and old[5] == entry[5]:
        return []
    return file_ranges(entry[0], entry[1:6], old and old[1:6], [(e[0], e[1:6]) for e in before if not _compressed(e[0])], at, range_bytes)


def admitted(folder: str, before: list[list], found: list[list], most: int | None, at: int,
             range_bytes: int) -> tuple[list[list], list[ByteRange]]:
    """The entries of a folder after at most ``most`` bytes of it are read, and the ranges of these."""
    entries, ranges, waiting = [], [], False
    for entry in sorted(found, key=lambda e: (not _rotated(os.path.basename(e[0])), e[6], e[0])):
        own = ranges_of(entry, before, at, range_bytes)
        size = sum(r.end - r.start for r in own)
        if most is not None and size > most:
            entry, own = (None, []) if most == 0 else (entry, own) if _compressed(entry[0]) else _cut(entry, before, most, at, range_bytes)
            waiting |= entry is None or not entry[5]
            size = most
        if entry is not None:
            entries.append(entry)
            ranges += own
            most = None if most is None else most - size
    if waiting:
        taken = {e[0]: e for e in entries}
        for e in before:
            new = taken.get(e[0])
            if e[7] or new is None or new[2] != e[2] or new[1] < e[1]:  # not just a file that was read on
                entries.append([*e[:7], e[7] or new is not None])
    return sorted(entries, key=lambda e: (e[0], e[7], e[1])), ranges


def _cut(entry: list, before: list[list], most: int, at: int, range_bytes: int) -> tuple[list | None, list[ByteRange]]:
    """A plain file as far as ``most`` bytes go. It has to be opened to see where it goes on: an earlier position beyond
    the cut would be overlooked otherwise."""
    try:
        with open(entry[0], "rb") as f:
            whole = file_ranges(entry[0], entry[1:6], None, [(e[0], e[1:6]) for e in before if not _compressed(e[0])], at, range_bytes)
            held = max((p for p, mark, _ in whole[0].earlier if _mark(f, p) == mark), default=0) if whole else 0
            end = min(entry[1], held + most)
            if end < entry[1]:
                entry = [entry[0], end, entry[2], _mark(f, end), entry[4], False, entry[6], False]
            if not entry[3]:
                return None, []  # shorter than it was listed
    except FileNotFoundError:
        return None, []
    base = [(e[0], e[1:6]) for e in before if e[1] == held and not _compressed(e[0])] if held else []
    return entry, file_ranges(entry[0], entry[1:6], None, base, at, range_bytes)


def as_range(fields: dict) -> ByteRange:
    return ByteRange(fields["path"], fields["fingerprint"], fields["start"], fields["end"], fields["first"], fields["closed"],
                     [tuple(e) for e in fields["earlier"]], fields["size"], fields["mark"], fields["collected_at"])


def collect_into(store: RunStore, tail: TailTable) -> list[str]:
    """Collect what is there, a run for each version, until a version is read that the bound did not cut short. Returns the
    names of the runs. Files that grow meanwhile are left to the next call."""
    from ..streaming.pipelines import as_log_lines

    names: list[str] = []
    while (planned := tail.plan()) is not None:
        version, _ = planned
        names += store.put(as_log_lines(tail.lines(version)))
        left = tail.left(version)
        tail.commit(version)
        if not left:
            break
    return names
