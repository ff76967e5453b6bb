"""Batch readers of log files: node trees, run directories, rotated files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import filename_parts, is_pod_dir, pod_dir_parts
from ..functions.text import line_bytes, sort_key
from ..operators.ordinals import line_chunks
from . import gzip_index

ACTIVE_GLOB = "*.log"
ROTATED_GLOB = "{0.log.*,*.log.*.gz}"


def _read(spark: SparkSession, root: str | list[str], glob: str, modified_after: str | None,
          recursive: bool) -> DataFrame:
    """Raw lines with their file and split. Only ``\\n`` ends a raw line, so byte counts stay exact."""
    reader = (spark.read.option("lineSep", "\n").option("pathGlobFilter", glob)
              .option("recursiveFileLookup", recursive))
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.text(root).select("value", F.col("_metadata.file_path").alias("path"),
                                    F.col("_metadata.file_block_start").alias("block_start"))


def numbered_text(raw: DataFrame) -> DataFrame:
    """Lines under the universal-newline rule, with ``line_no`` and ``start_byte`` per file.

    A raw line may hold lone ``\\r`` line ends and a ``\\r`` before its ``\\n``. Lines are counted
    per file split and the split totals added up, so one huge file is still read by many
    tasks and never ordered in a single one. Invalid UTF-8 keeps its bytes: text that needs
    splitting is split as Latin-1.
    """
    crlf = F.col("value").endswith("\r")
    latin = F.split(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), "\r", -1)
    cut = F.transform(latin, lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    cut = F.when(crlf, F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    pieces = F.when(F.col("value").contains("\r"), cut).otherwise(F.array("value"))
    lines = (raw.withColumn("_row", F.monotonically_increasing_id())
             .withColumns({"_crlf": crlf, "_pieces": pieces})
             .select("*", F.posexplode("_pieces").alias("_pos", "line")))
    last = F.col("_pos") == F.size("_pieces") - 1
    ends = F.when(last & F.col("_crlf"), 2).otherwise(1)
    lines = lines.withColumns({"n_bytes": line_bytes(F.col("line")), "_end": ends})
    numbered = line_chunks(lines, ["path"], ["_row", "_pos"], F.col("n_bytes") + F.col("_end"),
                           chunk=F.col("block_start")).numbered()
    return numbered.drop("value", "_row", "_pos", "_pieces", "_crlf", "_end", "block_start")


def _step(path: Column, back: int) -> Column:
    """The ``back``-th last step of a path, 0 being the file name."""
    return F.element_at(F.split(path, "/"), -1 - back)


def _is_node_file(path: Column, rotated: bool) -> Column:
    later = _step(path, 0).contains(".log.")
    return is_pod_dir(_step(path, 2)) & (later if rotated else ~later)


def _node_columns(path: Column) -> dict[str, Column]:
    return {**pod_dir_parts(_step(path, 2)), "container": _step(path, 1), "file_name": _step(path, 0)}


def _in_namespaces(path: Column, namespaces: Sequence[str] | None) -> Column:
    return F.lit(True) if namespaces is None else pod_dir_parts(_step(path, 2))["ns"].isin(list(namespaces))


def read_node_logs(spark: SparkSession, root: str, rotated: bool = False,
                   modified_after: str | None = None,
                   namespaces: Sequence[str] | None = None) -> DataFrame:
    """Container logs under ``<root>/<ns>_<pod>_<uid>/<container>/``, active or rotated files.

    Directories without ``_`` are skipped. Gzip files are decoded by extension; each is one task.
    What follows from the path is added after the lines were shuffled for numbering.
    """
    path = F.col("path")
    raw = _read(spark, root, ROTATED_GLOB if rotated else ACTIVE_GLOB, modified_after, recursive=True)
    lines = numbered_text(raw.where(_is_node_file(path, rotated) & _in_namespaces(path, namespaces)))
    return lines.withColumns({**_node_columns(path), "src_rank": F.lit(0 if rotated else 1),
                              "ts_key": sort_key(F.col("line"))})


def read_compressed_logs(spark: SparkSession, root: str, index: str, namespaces: Sequence[str] | None = None,
                         spacing: int = gzip_index.SPACING) -> DataFrame:
    """The compressed files among ``read_node_logs(rotated=True)``, with the same columns, a large one read by several tasks.

    ``index`` is a folder in which the places are kept where decoding can begin; files that it does not have are decoded
    once for that.
    """
    path = F.col("path")
    files = list_files(spark, root, "*.log.*.gz")
    pieces = gzip_index.update_index(spark, files.where(_is_node_file(path, True) & _in_namespaces(path, namespaces)), index, spacing)
    raw = gzip_index.read_pieces(pieces).select(F.col("line").alias("value"), "path", F.col("piece_start").alias("block_start"))
    return numbered_text(raw).withColumns({**_node_columns(path), "src_rank": F.lit(0), "ts_key": sort_key(F.col("line"))})


def list_node_files(spark: SparkSession, root: str, rotated: bool = False,
                    namespaces: Sequence[str] | None = None) -> DataFrame:
    """The files ``read_node_logs`` reads, with size and modification time; contents are not read."""
    path = F.col("path")
    files = list_files(spark, root, ROTATED_GLOB if rotated else ACTIVE_GLOB)
    return files.where(_is_node_file(path, rotated) & _in_namespaces(path, namespaces)).withColumns(
        _node_columns(path))


def read_rotated_and_active(spark: SparkSession, root: str, modified_after: str | None = None,
                            namespaces: Sequence[str] | None = None) -> DataFrame:
    """A container's rotated content, then its active content; sort by ``src_rank, file_name, line_no``."""
    rotated = read_node_logs(spark, root, True, modified_after, namespaces)
    return rotated.unionByName(read_node_logs(spark, root, False, None, namespaces))


def read_run(spark: SparkSession, root: str, run: str) -> DataFrame:
    """``log_lines`` of one run directory; name segments come from the file names."""
    return _log_lines(_read(spark, f"{root}/{run}", ACTIVE_GLOB, None, recursive=False))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """``log_lines`` of every run directory under ``root``; hidden directories are no runs."""
    raw = _read(spark, root, ACTIVE_GLOB, None, recursive=True)
    return _log_lines(raw.where(~_step(F.col("path"), 1).startswith(".")))


def _log_lines(raw: DataFrame) -> DataFrame:
    path, key = F.col("path"), sort_key(F.col("line"))
    parts = filename_parts(_step(path, 0))
    return numbered_text(raw).select(
        _step(path, 1).alias("run"), *[parts[c].alias(c) for c in ("ns", "pod")], F.lit("").alias("uid"),
        parts["container"].alias("container"), _step(path, 0).alias("filename"),
        "line_no", "start_byte", "n_bytes", "line", key.alias("ts_key"), F.try_to_timestamp(key).alias("ts"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files under ``root`` with size and modification time; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob).load(root)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"),
                    F.col("_metadata.file_modification_time").alias("mtime")))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Pod inventory, one ``<pod> <container>,<container>`` per line in a file per namespace.

    Rows with fewer than two fields are dropped; the file name without suffix is the namespace.
    """
    rows = spark.read.text(path).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("ns"),
        F.split(F.trim("value"), r"\s+").alias("fields"))
    return rows.where(F.size("fields") >= 2).select(
        "ns", F.get("fields", 0).alias("pod"), F.get("fields", 1).alias("containers"))
