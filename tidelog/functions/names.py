"""File, directory, run and archive names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RUN_FORMAT

ARCHIVE_PREFIX = "archive_"
ARCHIVE_SUFFIX = ".tar.gz"


def _part(parts: Column, index: int, default: str) -> Column:
    return F.coalesce(F.get(parts, index), F.lit(default))


def filename_parts(filename: Column, default: str = "") -> dict[str, Column]:
    """``<ns>__<pod>__<container>__<run>.log`` to its four segments; missing ones become ``default``.

    Only the last suffix is dropped, and a ``__`` inside a pod name shifts the segments.
    """
    parts = F.split(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), "__")
    return {name: _part(parts, i, default)
            for i, name in enumerate(["ns", "pod", "container", "run"])}


def pod_dir_parts(directory: Column) -> dict[str, Column]:
    """``<ns>_<pod>_<uid>`` to its segments."""
    parts = F.split(directory, "_")
    return {name: _part(parts, i, "") for i, name in enumerate(["ns", "pod", "uid"])}


def is_pod_dir(directory: Column) -> Column:
    return F.size(F.split(directory, "_")) >= 2


def container_key(ns: Column, pod: Column, container: Column) -> Column:
    return F.concat_ws("__", ns, pod, container)


def output_name(ns: Column, pod: Column, container: Column, run: Column,
                part: Column | None = None, previous: bool = False) -> Column:
    """Name of a collected file; parts after the first carry ``.partN``."""
    stem = F.concat(container_key(ns, pod, container), F.lit("__"), run)
    if previous:
        return F.concat(stem, F.lit(".previous.log"))
    if part is None:
        return F.concat(stem, F.lit(".log"))
    return F.concat(stem, part_suffix(part), F.lit(".log"))


def part_suffix(part: Column) -> Column:
    return F.when(part > 0, F.concat(F.lit(".part"), part.cast("string"))).otherwise(F.lit(""))


def part_filename(filename: Column, part: Column) -> Column:
    """The name a given part of ``filename`` gets."""
    stem = F.regexp_replace(filename, r"\.log$", "")
    return F.concat(stem, part_suffix(part), F.lit(".log"))


def display_name(filename: Column) -> Column:
    return F.replace(filename, F.lit(".log"), F.lit(""))


def source_label(filename: Column) -> Column:
    """``pod/container`` for a conventional name, else the file name itself."""
    parts = F.split(display_name(filename), "__")
    return F.when(F.size(parts) >= 3,
                  F.concat_ws("/", F.get(parts, 1), F.get(parts, 2))).otherwise(filename)


def run_timestamp(run: Column) -> Column:
    """Run name to timestamp; null when the name is not a run name."""
    return F.try_to_timestamp(run, F.lit(RUN_FORMAT))


def run_name(ts: Column) -> Column:
    return F.date_format(ts, RUN_FORMAT)


def utc_run_name(ts: Column) -> Column:
    """Run name of an instant in UTC, whatever the session's zone: names follow the order of time."""
    since = F.make_dt_interval(secs=F.unix_micros(ts) / 1_000_000)
    return F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + since, RUN_FORMAT)


def run_date_label(run: Column) -> Column:
    return F.coalesce(F.date_format(run_timestamp(run), "MMM dd, yyyy  HH:mm"), F.lit("—"))


def archive_name(run: Column) -> Column:
    return F.concat(F.lit(ARCHIVE_PREFIX), run, F.lit(ARCHIVE_SUFFIX))


def archive_run(filename: Column) -> Column:
    """The run an archive belongs to; the name unchanged where prefix or suffix is missing."""
    bare = F.replace(filename, F.lit(ARCHIVE_PREFIX), F.lit(""))
    return F.replace(bare, F.lit(ARCHIVE_SUFFIX), F.lit(""))
