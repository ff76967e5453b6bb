"""Run archives that can be opened again: compressed blocks of lines, and an index that says where each block is.

An object of an archive is a chain of gzip members, so any tool unpacks it to plain text. A member is a block: up to a
megabyte of consecutive lines of one file. The index is a table partitioned by run, with a row per block: file, first line
and byte, object, offset, length, digest. Reading a file back looks up its rows and fetches those byte ranges alone,
spread over tasks; a block whose digest differs is an error, not a shorter file.

Objects are written by tasks under names of their own, and an object counts only by its index rows, which Spark commits
for successful tasks alone: a repeated or lost task leaves at most a file that nothing refers to, which ``sweep_archives``
removes.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import archive_name
from ..functions.text import sort_key
from ..schemas import ARCHIVES, LOG_LINES
from .folders import delete_folder, list_folders

BLOCK_BYTES = 1 << 20
LEADING = ["run", "filename", "ns", "pod", "uid", "container"]
LONGS = ["first_line", "first_byte", "n_lines", "offset", "length"]
INDEX = T.StructType([T.StructField(c, T.LongType() if c in LONGS else T.StringType()) for c in [*LEADING, *LONGS, "object", "digest"]])


def open_storage(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Archive:
    """Folders of an archive store."""

    def __init__(self, path: str):
        self.data, self.index = f"{path}/data", f"{path}/index"


class _Objects:
    """The objects a task writes, one for each run it has lines of."""

    def __init__(self, folder: str):
        self.folder, self.run, self.stream, self.name, self.at = folder, None, None, "", 0

    def add(self, run: str, member: bytes) -> tuple[str, int]:
        """Append a block; where it is."""
        if run != self.run:
            self.close()
            self.run, self.at = run, 0
            self.name = f"run={run}/{uuid.uuid4().hex}.log.gz"
            storage, path = open_storage(f"{self.folder}/{self.name}")
            storage.create_dir(path.rpartition("/")[0])
            self.stream = storage.open_output_stream(path, compression=None)
        self.stream.write(member)
        self.at += len(member)
        return self.name, self.at - len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _block(lines: list[str], sizes: list[int]) -> bytes:
    """Lines with their line ends; one whose size counts a carriage return gets it back."""
    out = bytearray()
    for line, size in zip(lines, sizes):
        text = line.encode("utf-8", "surrogateescape")
        out += text + (b"\r\n" if size == len(text) + 1 else b"\n")
    return gzip.compress(bytes(out), 6, mtime=0)


def write_archives(lines: DataFrame, runs: Sequence[str], path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Archive the given runs of ``lines``, replacing earlier archives of them; returns their ``archives`` rows.

    A run without a line gets no archive. Lines need the columns of ``log_lines``.
    """
    spark, store = lines.sparkSession, Archive(path)
    chosen = lines.where(F.col("run").isin(list(runs)))
    for run in runs:  # first the index, so that no row ever leads to an object that is gone
        delete_folder(spark, f"{store.index}/run={run}")
    for run in runs:
        delete_folder(spark, f"{store.data}/run={run}")
    folder = store.data

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects, held, sizes, head, size = _Objects(folder), [], [], None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                member = _block(held, sizes)
                name, offset = objects.add(head["run"], member)
                row = {c: head[c] for c in LEADING} | {
                    "first_line": head["line_no"], "first_byte": head["start_byte"], "n_lines": len(held), "object": name,
                    "offset": offset, "length": len(member), "digest": hashlib.sha256(member).hexdigest()}
                yield pa.RecordBatch.from_pylist([row], SCHEMA)

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    follows = head is not None and all(row[c] == head[c] for c in LEADING) and row["line_no"] == head["line_no"] + len(held)
                    if not follows or size >= block_bytes:
                        yield from flush()
                        held, sizes, head, size = [], [], row, 0
                    held.append(row["line"] or "")
                    sizes.append(row["n_bytes"])
                    size += row["n_bytes"] + 1
            yield from flush()
        finally:
            objects.close()

    ordered = chosen.select(*LEADING, "line_no", "start_byte", "n_bytes", "line").hint("rebalance", "run")
    index = ordered.sortWithinPartitions("run", "filename", "line_no").mapInArrow(write, INDEX)
    (index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(store.index))
    return archive_rows(spark, path, runs)


SCHEMA = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in INDEX])


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives; none if nothing was ever archived."""
    folder = Archive(path).index
    if not list_folders(spark, folder):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(folder).select(*INDEX.fieldNames())


def archive_rows(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """``archives`` rows: name, run and bytes on storage of each archived run."""
    index = archive_index(spark, path)
    if runs is not None:
        index = index.where(F.col("run").isin(list(runs)))
    return index.groupBy("run").agg(F.sum("length").alias("size_bytes")).select(
        archive_name(F.col("run")).alias("filename"), "run", "size_bytes",
        F.current_timestamp().alias("created_at")).select(*ARCHIVES.fieldNames())


def read_archived(spark: SparkSession, path: str, runs: Sequence[str] | None = None,
                  filenames: Sequence[str] | None = None) -> DataFrame:
    """``log_lines`` of archived runs or files, from the blocks that hold them and no others."""
    index = archive_index(spark, path)
    if runs is not None:
        index = index.where(F.col("run").isin(list(runs)))
    if filenames is not None:
        index = index.where(F.col("filename").isin(list(filenames)))
    return open_blocks(index, path)


def open_blocks(index: DataFrame, path: str) -> DataFrame:
    """``log_lines`` of the blocks in some index rows, which may be any subset."""
    folder = Archive(path).data

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["object"] != name:
                    if source is not None:
                        source.close()
                    storage, at = open_storage(f"{folder}/{row['object']}")
                    name, source = row["object"], storage.open_input_file(at)
                member = source.read_at(row["length"], row["offset"])
                if hashlib.sha256(member).hexdigest() != row["digest"]:
                    raise ValueError(f"{row['run']}/{row['filename']}: the block at {row['offset']} of {name} is damaged")
                texts = gzip.decompress(bytes(member)).split(b"\n")[:-1]
                sizes = [len(t) for t in texts]
                starts, at = [], row["first_byte"]
                for size in sizes:
                    starts.append(at)
                    at += size + 1
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([row[c]] * n, pa.string()) for c in LEADING),
                     pa.array(range(row["first_line"], row["first_line"] + n), pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array([t.removesuffix(b"\r").decode("utf-8", "replace") for t in texts], pa.string())],
                    [*LEADING, "line_no", "start_byte", "n_bytes", "line"])
        if source is not None:
            source.close()

    blocks = index.repartition("object").sortWithinPartitions("object", "offset")
    lines = blocks.mapInArrow(read, "run string, filename string, ns string, pod string, uid string, container string, "
                                    "line_no bigint, start_byte bigint, n_bytes bigint, line string")
    key = sort_key(F.col("line"))
    return lines.withColumns({"ts_key": key, "ts": F.try_to_timestamp(key)}).select(*LOG_LINES.fieldNames())


def sweep_archives(spark: SparkSession, path: str) -> int:
    """Remove objects that no index row refers to; how many there were. Not while an archive is written."""
    store, removed = Archive(path), 0
    for folder in list_folders(spark, store.data):
        run = folder.removeprefix("run=")
        known = {r.object.rpartition("/")[2] for r in archive_index(spark, path).where(F.col("run") == run).select("object").distinct().collect()}
        storage, at = open_storage(f"{store.data}/{folder}")
        for found in storage.get_file_info(fs.FileSelector(at)):
            if found.base_name not in known:
                storage.delete_file(found.path)
                removed += 1
    return removed
