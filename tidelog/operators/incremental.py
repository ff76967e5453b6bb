"""What is new since the last run: saved offsets, rotation, and the second (API) phase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import API_OVERLAP_S, CONTAINER
from .ordinals import KEY, line_chunks
from .sizes import keep_small


def effective_offset(size: Column, saved: Column) -> Column:
    """Where reading resumes: 0 for an unknown or shrunken (rotated) file."""
    return F.when(saved.isNull() | (size < saved), F.lit(0)).otherwise(saved).cast("bigint")


def with_offsets(files: DataFrame, offsets: DataFrame, path: str = "filename") -> DataFrame:
    """Files with their saved offset (0 when none), resume point, rotation flag and new bytes."""
    saved = offsets.select(F.col("path").alias(path), F.col("byte_offset").alias("_saved"))
    return (files.join(saved, path, "left")
            .withColumn("byte_offset", F.coalesce("_saved", F.lit(0)))
            .withColumn("effective_offset", effective_offset(F.col("size_bytes"), F.col("_saved")))
            .withColumn("rotated", F.col("size_bytes") < F.col("byte_offset"))
            .withColumn("new_bytes", F.col("size_bytes") - F.col("effective_offset"))
            .drop("_saved"))


def files_with_new_data(files: DataFrame, offsets: DataFrame, path: str = "filename") -> DataFrame:
    """Files that hold bytes past their resume point; a rotated file is read from its start."""
    return with_offsets(files, offsets, path).where(F.col("new_bytes") > 0)


def incremental_lines(lines: DataFrame, files: DataFrame, offsets: DataFrame, order: Sequence[str] = (),
                      path: str = "filename", bounds: list[list] | None = None) -> DataFrame:
    """Lines that end after the resume point of their file; a half-read line comes back whole.

    First whole files: the catalog knows which ones hold new bytes, and all others are
    dropped before anything is shuffled. Lines with a stored ``start_byte`` then need a filter
    only. Others are numbered along ``order``: whole chunks are dropped, then lines, and resume
    points meet the one-row-per-chunk table, so a hot file cannot skew that join.
    """
    pending = with_offsets(files, offsets, path).where(F.col("new_bytes") > 0)
    pending = keep_small(pending.select(path, "effective_offset"))
    if "start_byte" in lines.columns:
        return _ending_after(lines.join(pending, path), "effective_offset")
    chunks = line_chunks(lines.join(pending.select(path), path, "left_semi"), [path], order,
                         F.col("n_bytes") + 1, bounds=bounds)
    resume = pending.select(F.struct(path).alias(KEY), "effective_offset")
    starts = chunks.starts.join(resume, KEY).where(
        F.col("first_byte") + F.col("chunk_bytes") > F.col("effective_offset"))
    return _ending_after(chunks.numbered(starts, keep=["effective_offset"]), "effective_offset")


def _ending_after(lines: DataFrame, offset: str) -> DataFrame:
    return lines.where(F.col("start_byte") + F.col("n_bytes") + 1 > F.col(offset))


def skip_collected(rotated_lines: DataFrame, skips: DataFrame, name: str = "file_name",
                   keys: Sequence[str] = CONTAINER) -> DataFrame:
    """Lines of rotated files past the bytes collected before the rotation (``rotated_skip_bytes``)."""
    known = skips.where(F.col("skip_bytes") > 0).select(*keys, F.col("name").alias(name), "skip_bytes")
    joined = rotated_lines.join(keep_small(known), [*keys, name], "left")
    passed = F.col("start_byte") + F.col("n_bytes") + 1 > F.coalesce("skip_bytes", F.lit(0))
    return joined.where(passed).drop("skip_bytes")


def next_offsets(files: DataFrame, path: str = "filename") -> DataFrame:
    """Offsets to save: the current size of every listed file."""
    return files.select(F.col(path).alias("path"), F.col("size_bytes").alias("byte_offset"))


def dead_offsets(offsets: DataFrame, files: DataFrame, path: str = "filename") -> DataFrame:
    """Saved offsets whose file is gone."""
    return offsets.join(files.select(F.col(path).alias("path")), "path", "left_anti")


def rotated_skip_bytes(rotated: DataFrame, active_offsets: DataFrame, last_mtime: Column,
                       keys: Sequence[str] = CONTAINER) -> DataFrame:
    """Bytes of each rotated file that were collected while it still was the active file.

    Only the newest file rotated since the last run can be that file. The newest name is an
    aggregate, so a container with very many rotated files is never sorted in one task.
    """
    keys = list(keys)
    newest = (rotated.where(F.col("mtime") > last_mtime).groupBy(*keys)
              .agg(F.max("name").alias("name"))
              .join(active_offsets.select(*keys, "byte_offset"), keys))
    usable = (F.col("byte_offset") > 0) & (F.col("size_bytes") >= F.col("byte_offset"))
    return (rotated.join(newest, [*keys, "name"], "left")
            .withColumn("skip_bytes", F.when(usable, F.col("byte_offset")).otherwise(F.lit(0)).cast("bigint"))
            .drop("byte_offset"))


def explode_inventory(inventory: DataFrame) -> DataFrame:
    """One row per container of a pod's comma-separated list."""
    names = F.transform(F.split("containers", ","), lambda name: F.trim(name))
    return inventory.select("ns", "pod", F.explode(names).alias("container"))


def api_candidates(containers: DataFrame, coverage: DataFrame) -> DataFrame:
    """Containers to ask the API for: all but those covered on the node without rotation."""
    done = coverage.where(~F.col("rotated")).select(*CONTAINER)
    return containers.join(done, CONTAINER, "left_anti")


def uncovered(containers: DataFrame, coverage: DataFrame) -> DataFrame:
    """Containers whose current lines come from the API: those the node phase did not cover at all."""
    return containers.join(coverage.select(*CONTAINER), CONTAINER, "left_anti")


def previous_only(containers: DataFrame, coverage: DataFrame) -> DataFrame:
    """Containers whose previous instance alone is fetched: covered and rotated."""
    return containers.join(coverage.where("rotated").select(*CONTAINER), CONTAINER, "left_semi")


def without_output(containers: DataFrame, outputs: DataFrame) -> DataFrame:
    """Containers that have no non-empty output file yet."""
    return containers.join(outputs.where(F.col("size_bytes") > 0).select(*CONTAINER), CONTAINER, "left_anti")


def lines_of(lines: DataFrame, containers: DataFrame) -> DataFrame:
    """Lines of the given containers; a container list of ordinary size spares the lines a shuffle."""
    return lines.join(keep_small(containers.select(*CONTAINER)), CONTAINER, "left_semi")


def since_window(lines: DataFrame, now: Column, last: Column | None,
                 overlap_s: int = API_OVERLAP_S) -> DataFrame:
    """Lines since the last run plus an overlap; the first run (``last`` None) is unbounded."""
    if last is None:
        return lines
    since = last - F.make_dt_interval(secs=F.lit(overlap_s))
    return lines.where((F.col("ts") >= since) & (F.col("ts") <= now))


def drop_overlap(lines: DataFrame, keys: Sequence[str] = CONTAINER, fetch: str = "batch") -> DataFrame:
    """Each line as often as the fetch that holds most copies of it returned it.

    Copies within one fetch are genuine repeats, copies in several fetches are their overlap. Counts
    combine map-side, so a line that is repeated very often moves as one row per task.
    """
    line = [*keys, "ts", "line"]
    counted = lines.groupBy(fetch, *line).agg(F.count(F.lit(1)).alias("_copies"))
    most = counted.groupBy(*line).agg(F.max("_copies").alias("_copies"))
    return most.select(*line, F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("_copy")).drop("_copy")


def number_copies(fetched: DataFrame, keys: Sequence[str] = CONTAINER, fetch: str = "batch") -> DataFrame:
    """Number the copies of each line within its fetch, as ``copy``, so that streams keep genuine repeats."""
    line = [fetch, *keys, "ts", "line"]
    counted = fetched.groupBy(*line).agg(F.count(F.lit(1)).alias("_copies"))
    return counted.select(*line, F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("copy"))


def union_rotated_active(rotated: DataFrame, active: DataFrame) -> DataFrame:
    """Rotated content before active content, per container; sort by ``src_rank, name``."""
    return (rotated.withColumn("src_rank", F.lit(0))
            .unionByName(active.withColumn("src_rank", F.lit(1)), allowMissingColumns=True))


def union_phases(node_lines: DataFrame, api_lines: DataFrame | None,
                 previous_lines: DataFrame | None = None) -> DataFrame:
    """Lines of all phases, tagged `node`, `api` and `previous`; None switches a phase off.

    The API gives current lines of containers the node phase did not cover (`uncovered`), and the previous
    instance of those that were covered and rotated (`previous_only`), so that no line is fetched twice.
    """
    both = node_lines.withColumn("phase", F.lit("node"))
    for phase, lines in (("api", api_lines), ("previous", previous_lines)):
        if lines is not None:
            both = both.unionByName(lines.withColumn("phase", F.lit(phase)), allowMissingColumns=True)
    return both


def phase_counts(lines: DataFrame) -> DataFrame:
    """Containers collected per phase, and their sum over the phases as ``total``."""
    phases = (lines.select("phase", *CONTAINER).distinct()
              .groupBy("phase").agg(F.count(F.lit(1)).alias("containers")))
    total = phases.agg(F.coalesce(F.sum("containers"), F.lit(0)).alias("containers"))
    return phases.unionByName(total.select(F.lit("total").alias("phase"), "containers"))
