"""What several operators share: the shared folder, stored tables, Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.folders import shared_folder  # noqa: F401  the operators take it from here

PIECE_BYTES = 4 << 20  # texts a Python function holds at once, unless one text alone is longer
PIECE_ROWS = 1 << 15


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and it survives lost executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(column: str = "text"):
    """Tells rows apart that share a doc_id; null and empty texts are told apart too."""
    return F.xxhash64(F.col(column), F.col(column).isNull())


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts have about `limit` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            to = min(to, at + PIECE_ROWS)
            yield batch.slice(at, to - at)
            at = to


def tidy(function: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back to the system at its end: Python workers serve many
    tasks, and what their allocators keep adds up. What a worker's first task finds there, its modules, is not searched
    for garbage again after each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gc.get_freeze_count():
            gc.freeze()
        yield from function(batches)
        release()

    return run


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and n + 1 offsets into them. Null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]
