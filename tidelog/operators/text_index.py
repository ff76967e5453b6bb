"""An inverted filter for full-text search: which chunks of a line table hold which character trigrams.

Lines are stored in chunks, each in a folder of its own (``run=…/chunk=…``). Beside them stands a table with a row per
(run, trigram, 1024 chunks) that lists the chunks in which the trigram occurs. A search reads the few rows of its needle's
trigrams, intersects their chunks, and opens only the folders that are left; lines are then compared as by a full scan.

* Trigrams are of the lower-cased line, as the search compares it, so any needle of three or more characters works,
  in any script. A shorter one, or one with a line feed, reads all chunks of the wanted runs.
* The filter of a run is removed before its lines change and written after them. A run without a filter is read whole, so
  a search never misses lines, whatever step an update stopped at.
* A trigram is a number of three code points; rows are sorted by it, so Parquet's statistics skip the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import delete_folder, list_folders
from .filters import search_lines

GRAM = 3
CHUNK_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024  # neighbouring lines that stay together
CHUNKS_PER_ROW = 1024
SLICES = 16  # files of a run's filter
MAX_PATHS = 10_000  # chunk folders that are named one by one; more are found by a join
PIECE_BYTES = 4 << 20
SEPARATOR = 10


class IndexedLines:
    """Where a line table and its filter are. ``schema`` has the columns of the lines, ``run`` among them."""

    def __init__(self, root: str, schema: T.StructType):
        self.lines, self.grams = f"{root}/lines", f"{root}/grams"
        self.schema = T.StructType([*schema.fields, T.StructField("chunk", T.IntegerType())])


def gram_numbers(text: str) -> list[int]:
    """The distinct trigrams of a text as numbers."""
    return sorted({(ord(a) << 42) | (ord(b) << 21) | ord(c) for a, b, c in zip(text, text[1:], text[2:])})


def _grams(column: pa.Array) -> np.ndarray:
    """The distinct trigrams of some lines; none reaches from one line into the next."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    ended = np.insert(raw, at[1:] - at[0], SEPARATOR).tobytes().decode("utf-8", "replace")
    points = np.frombuffer(ended.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    numbers = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    inner = points != SEPARATOR
    return pd.unique(numbers[inner[:-2] & inner[1:-1] & inner[2:]])


def chunk_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, slice, gram, chunk): the distinct trigrams of every chunk, from (run, chunk, text) with a chunk's rows together.
    A chunk that two tasks share gives rows from both."""
    key, held = None, np.zeros(0, np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for low in range(0, len(held), 1 << 16):
            some = held[low:low + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(some), pa.string()), pa.array(some % SLICES, pa.int64()), pa.array(some, pa.int64()),
                 pa.array(np.full(len(some), key[1]), pa.int32())], ["run", "slice", "gram", "chunk"])

    for batch in batches:
        chunks, runs = np.asarray(batch.column("chunk")), batch.column("run")
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        at = 0
        while at < len(batch):
            now = (runs[at].as_py(), int(chunks[at]))
            if now != key:
                yield from flush()
                key, held = now, np.zeros(0, np.int64)
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE_BYTES, side="right")))
            other = np.flatnonzero((chunks[at:to] != now[1]) | ~np.asarray(pc.equal(runs.slice(at, to - at), now[0])))
            to = at + int(other[0]) if len(other) else to
            held = pd.unique(np.concatenate([held, _grams(batch.column("text").slice(at, to - at))]))
            at = to
    if key is not None:
        yield from flush()


def write_indexed_lines(lines: DataFrame, store: IndexedLines, block: Sequence[str | Column] | None = None,
                        chunk_bytes: int = CHUNK_BYTES) -> list[str]:
    """Replace the runs in ``lines`` and their filters; other runs are left alone. Returns the names of the runs.

    ``block`` tells which lines stay together, by default a megabyte of a file; blocks are dealt to as many chunks as the
    run's bytes need, so a hot file fills several chunks and small files share one.
    """
    spark = lines.sparkSession
    block = [F.col("filename"), F.floor(F.col("start_byte") / BLOCK_BYTES)] if block is None else list(block)
    sizes = lines.groupBy("run").agg(F.sum(F.octet_length("line") + 1).alias("bytes")).collect()  # a row a run
    if not sizes:
        return []
    runs = sorted(r.run for r in sizes)
    for run in runs:  # first what finds lines, then the lines
        delete_folder(spark, f"{store.grams}/run={run}")
    for run in runs:
        delete_folder(spark, f"{store.lines}/run={run}")
    counts = spark.createDataFrame([(r.run, max(1, math.ceil((r.bytes or 0) / chunk_bytes))) for r in sizes], "run string, chunks int")
    dealt = lines.join(counts, "run").withColumn("chunk", F.pmod(F.xxhash64(*block), F.col("chunks")).cast("int"))
    (dealt.select(*store.schema.fieldNames()).repartition("run", "chunk").sortWithinPartitions("run", "chunk")
     .write.mode("append").partitionBy("run", "chunk").parquet(store.lines))
    index_runs(spark, store, runs)
    return runs


def index_runs(spark: SparkSession, store: IndexedLines, runs: Sequence[str]) -> None:
    """Write the filters of runs whose lines are stored."""
    written = _read(spark, store, [f"{store.lines}/run={run}" for run in runs])
    found = written.select("run", "chunk", F.lower("line").alias("text")).mapInArrow(
        chunk_grams, "run string, slice bigint, gram bigint, chunk int")
    row = F.floor(F.col("chunk") / CHUNKS_PER_ROW)
    postings = (found.repartition("run", "slice").groupBy("run", "slice", "gram", row.alias("row"))
                .agg(F.sort_array(F.collect_set("chunk")).alias("chunks")))  # at most CHUNKS_PER_ROW numbers
    (postings.sortWithinPartitions("run", "gram").select("run", "gram", "chunks")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(store.grams))


def _read(spark: SparkSession, store: IndexedLines, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], store.schema)
    return spark.read.schema(store.schema).option("basePath", store.lines).parquet(*paths).select(*store.schema.fieldNames())


def _runs(spark: SparkSession, folder: str, run_from: str | None, run_to: str | None) -> list[str]:
    names = [name.removeprefix("run=") for name in list_folders(spark, folder) if name.startswith("run=")]
    return [n for n in names if (not run_from or n >= run_from) and (not run_to or n <= f"{run_to}_99-99-99")]


def candidate_chunks(spark: SparkSession, store: IndexedLines, grams: Sequence[int], runs: Sequence[str]) -> DataFrame:
    """(run, chunk) of the chunks that hold every one of some trigrams."""
    rows = (spark.read.schema("run string, gram bigint, chunks array<int>").option("basePath", store.grams)
            .parquet(*[f"{store.grams}/run={run}" for run in runs]).where(F.col("gram").isin(list(grams))))
    each = rows.select("run", F.explode("chunks").alias("chunk"))
    return each.groupBy("run", "chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("run", "chunk")


def chunks_to_read(spark: SparkSession, store: IndexedLines, query: str, run_from: str | None = None,
                   run_to: str | None = None) -> DataFrame:
    """The stored lines of all chunks that may hold ``query``. Runs one job over the filter's rows of the query's trigrams."""
    runs = _runs(spark, store.lines, run_from, run_to)
    lowered = spark.range(1).select(F.lower(F.lit(query)).alias("q")).first().q
    grams = gram_numbers(lowered)
    if len(lowered) < GRAM or chr(SEPARATOR) in lowered:
        return _read(spark, store, [f"{store.lines}/run={run}" for run in runs])
    has_filter = set(_runs(spark, store.grams, run_from, run_to))
    indexed, rest = [r for r in runs if r in has_filter], [r for r in runs if r not in has_filter]
    whole = [f"{store.lines}/run={run}" for run in rest]
    if not indexed:
        return _read(spark, store, whole)
    found = candidate_chunks(spark, store, grams, indexed)
    named = found.limit(MAX_PATHS + 1).collect()
    if len(named) <= MAX_PATHS:
        return _read(spark, store, sorted([f"{store.lines}/run={r.run}/chunk={r.chunk}" for r in named] + whole))
    some = _read(spark, store, [f"{store.lines}/run={run}" for run in indexed]).join(found, ["run", "chunk"], "left_semi")
    return some.unionByName(_read(spark, store, whole))


def search_indexed_lines(spark: SparkSession, store: IndexedLines, query: str, namespaces: Sequence[str] | None = None,
                         run_from: str | None = None, run_to: str | None = None) -> DataFrame:
    """The rows of ``filters.search_lines`` over all stored lines, from the chunks that may hold them."""
    return search_lines(chunks_to_read(spark, store, query, run_from, run_to), query, namespaces, run_from, run_to).drop("chunk")
