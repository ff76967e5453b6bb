"""Line numbers, byte positions and first/last-N, without ever holding one file in one task.

A plain ``row_number() over (partition by file order by ...)`` sends a whole file to one task,
which fails when a single source holds a large share of all rows. Here every file is cut
into chunks that follow the sort order: one shuffle on ``(file, chunk)`` numbers rows inside
a chunk, and the per-chunk totals (one small row each) give every chunk its starting number.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_micros

KEY = "_file_key"
CHUNK = "_chunk"

ROWS_PER_CHUNK = 1 << 16
MAX_CHUNKS = (1 << 16) - 1
SAMPLES_PER_CHUNK = 16
MAX_SAMPLES = 1 << 18
GROUP_LIMIT_ROWS = 1_000      # above this Spark no longer prunes a ranked window before its shuffle
TOP_N_SALTS = 64
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def chunk_bounds(df: DataFrame, order: Sequence[str], rows_per_chunk: int | None = None,
                 rows: int | None = None) -> list[list]:
    """Sorted splitters that cut ``df`` into about even chunks along ``order``.

    Runs a count (footer-only for a bare Parquet table; pass ``rows`` to skip it) and reads a
    bounded random sample of the order columns. The splitters only decide where chunks end,
    so results do not depend on them; they are kept as literals so that every branch and
    every retried task cuts at the same places.
    """
    rows = df.count() if rows is None else rows
    chunks = min(MAX_CHUNKS, math.ceil(rows / (rows_per_chunk or ROWS_PER_CHUNK)))
    if chunks <= 1:
        return []
    wanted = min(chunks * SAMPLES_PER_CHUNK, MAX_SAMPLES)
    keys = df.select(*_comparable(df, order))
    if wanted < rows:
        keys = keys.sample(wanted / rows, seed=7)
    sample = sorted([list(r) for r in keys.collect() if None not in r])
    step = max(1, len(sample) / chunks)
    cuts = [sample[int(i * step)] for i in range(1, chunks) if int(i * step) < len(sample)]
    return [cut for i, cut in enumerate(cuts) if i == 0 or cut != cuts[i - 1]]


def _comparable(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Order columns as bigint or string, so that a splitter survives the trip through JSON."""
    kinds = dict(df.dtypes)
    out = []
    for i, name in enumerate(order):
        column = F.col(name)
        if kinds[name].startswith("timestamp"):
            column = epoch_micros(column, kinds[name])
        elif kinds[name] in INTEGERS:
            column = column.cast("bigint")
        elif kinds[name] != "string":
            raise TypeError(f"cannot cut chunks along {name} of type {kinds[name]}")
        out.append(column.alias(f"c{i}"))
    return out


def _with_chunk(df: DataFrame, order: Sequence[str], bounds: list[list]) -> DataFrame:
    """Add CHUNK: a number that never falls along ``order`` and grows at every splitter."""
    if not bounds:
        return df.withColumn(CHUNK, F.lit(0))
    lead = [cut[0] for cut in bounds]
    distinct = sorted(set(lead))
    repeats = max(Counter(lead).values())
    if isinstance(lead[0], str) or repeats > 2:
        return df.withColumn(CHUNK, _chunk_by_search(df, order, bounds))
    return _chunk_by_lead(df, order, distinct)


def _chunk_by_lead(df: DataFrame, order: Sequence[str], lead: list[int]) -> DataFrame:
    """Buckets of the first order column; equal values share one, which a splitter rarely cuts."""
    from pyspark.ml.feature import Bucketizer

    splits = sorted({float(v) for v in lead})
    value = F.coalesce(_comparable(df, order[:1])[0].cast("double"), F.lit(float("-inf")))
    bucketed = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_lead", outputCol="_bucket")
    return (bucketed.transform(df.withColumn("_lead", value))
            .withColumn(CHUNK, F.coalesce(F.col("_bucket").cast("int"), F.lit(0))).drop("_lead", "_bucket"))


def _chunk_by_search(df: DataFrame, order: Sequence[str], bounds: list[list]) -> Column:
    """Number of splitters at or below the row, compared as a whole: a binary search.

    Needed where one value of the first order column holds several chunks, and for strings.
    """
    keys = _comparable(df, order[:len(bounds[0])])
    kinds = dict(df.select(*keys).dtypes)
    fields = ",".join(f"c{i}:{kinds[f'c{i}']}" for i in range(len(keys)))
    rows = [{f"c{i}": v for i, v in enumerate(cut)} for cut in bounds]
    splitters = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    steps = [F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))]

    def advance(state: Column, step: Column) -> Column:
        key, at = state["key"], state["at"]
        passed = key >= F.get(splitters, at + step - 1)
        return F.struct(key.alias("key"), F.when(passed, at + step).otherwise(at).alias("at"))

    # The row's key rides in the state, so that it is worked out once per row.
    start = F.struct(F.struct(*keys).alias("key"), F.lit(0).alias("at"))
    found = F.aggregate(F.array(*steps), start, advance, lambda state: state["at"])
    return F.coalesce(found, F.lit(0))


@dataclass
class LineChunks:
    """Rows numbered inside their chunk, and one small row per chunk saying where it starts.

    ``rows``   : input columns (those of the key inside KEY only) + KEY, CHUNK, local_no, local_start
    ``starts`` : KEY, CHUNK, first_line, first_byte, chunk_bytes, file_lines, file_bytes
    """

    rows: DataFrame
    starts: DataFrame
    columns: list[str]
    keys: list[str]
    single: bool

    def numbered(self, starts: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Rows with final ``line_no`` and ``start_byte``, joined chunk by chunk.

        A table that fits one chunk as a whole starts at zero everywhere and needs no join.
        Filtering ``starts`` first skips whole chunks; extra columns in ``keep`` are carried over.
        """
        if starts is None and self.single:
            joined = self.rows.withColumns({"first_line": F.lit(0), "first_byte": F.lit(0)})
        else:
            joined = self.rows.join(self.starts if starts is None else starts, [KEY, CHUNK])
        columns = [F.col(f"{KEY}.`{c}`") if c in self.keys else F.col(c) for c in self.columns]
        return joined.select(
            *columns, *keep,
            (F.col("first_line") + F.col("local_no")).alias("line_no"),
            (F.col("first_byte") + F.col("local_start")).alias("start_byte"))


def line_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                size: Column | None = None, chunk: Column | None = None,
                bounds: list[list] | None = None, **bounds_args) -> LineChunks:
    """Cut every file (``keys``) along ``order`` and total each chunk.

    ``order`` must be unique within a file. ``size`` is the bytes a row occupies, line end
    included. Give ``chunk`` when a monotone piece number exists already (a file split), or
    ``bounds`` over the leading columns of ``order``.
    A null key forms a group of its own, as in GROUP BY.
    """
    if chunk is None and bounds is None:
        bounds = chunk_bounds(df, order, **bounds_args)
    cut = _with_chunk(df, order, bounds) if chunk is None else df.withColumn(CHUNK, chunk)
    size = F.lit(0).cast("bigint") if size is None else size.cast("bigint")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    cut = cut.withColumns({KEY: key, "_size": size})

    totals = cut.groupBy(KEY, CHUNK).agg(F.count(F.lit(1)).alias("_lines"),
                                         F.sum("_size").alias("chunk_bytes"))
    whole = Window.partitionBy(KEY)
    before = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        KEY, CHUNK, "chunk_bytes",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("first_line"),
        F.coalesce(F.sum("chunk_bytes").over(before), F.lit(0)).alias("first_byte"),
        F.sum("_lines").over(whole).alias("file_lines"),
        F.sum("chunk_bytes").over(whole).alias("file_bytes"))

    inside = Window.partitionBy(KEY, CHUNK).orderBy(*order)
    rows = cut.withColumns({
        "local_no": F.row_number().over(inside).cast("bigint"),
        "local_start": F.coalesce(
            F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }).drop("_size", *keys)
    return LineChunks(rows, starts, df.columns, list(keys), chunk is None and not bounds)


def number_lines(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 size: Column | None = None, **chunk_args) -> DataFrame:
    """Add ``line_no`` (1-based) and ``start_byte`` (bytes before the line in its file)."""
    return line_chunks(df, keys, order, size, **chunk_args).numbered()


def _salt(df: DataFrame, order: Sequence[str], salts: int) -> Column:
    """A salt shared by neighbours in sort order.

    Files are mostly laid out along their order, so a map task sees few salts and its
    own group limit still leaves about ``n`` rows per group. Any layout gives exact results.
    """
    kinds = dict(df.dtypes)
    blocks = []
    for name in order:
        if kinds[name].startswith("timestamp"):
            blocks.append(F.floor(F.unix_seconds(F.col(name).cast("timestamp")) / 3_600))
        elif kinds[name] in INTEGERS:
            blocks.append(F.shiftright(F.col(name).cast("bigint"), 20))
        else:
            blocks.append(F.col(name))
    return F.pmod(F.xxhash64(*blocks), F.lit(salts))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str = "rank",
            last: bool = False, salts: int = TOP_N_SALTS) -> DataFrame:
    """First (or last) ``n`` rows per group along ``order``, ranked from 1.

    Ranked in two steps: inside a salted piece of the group, then over the at most
    ``n * salts`` rows that are left, so a hot group is never sorted in one task. For ``n`` up
    to the group-limit threshold, map tasks also drop all but the first rows before the shuffle.
    """
    along = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    piece = Window.partitionBy(*keys, "_salt").orderBy(*along)
    group = Window.partitionBy(*keys).orderBy(*along)
    return (df.withColumn("_salt", _salt(df, order, salts))
            .withColumn("_n", F.row_number().over(piece)).where(F.col("_n") <= n)
            .drop("_salt", "_n")
            .withColumn(rank, F.row_number().over(group)).where(F.col(rank) <= n)
            .withColumn(rank, F.col(rank).cast("bigint")))


def head_lines(lines: DataFrame, n: int, keys: Sequence[str] = ("run", "filename"),
               order: Sequence[str] = ("line_no",)) -> DataFrame:
    """First ``n`` lines per file: a filter where ``line_no`` is stored, else a ranked window."""
    if "line_no" in lines.columns:
        return lines.where(F.col("line_no") <= n)
    if n > GROUP_LIMIT_ROWS:
        return number_lines(lines, keys, order).where(F.col("line_no") <= n).drop("start_byte")
    return first_n(lines, keys, order, n, rank="line_no")


def tail_lines(lines: DataFrame, n: int, keys: Sequence[str] = ("run", "filename"),
               order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Last ``n`` lines per file, with ``line_no`` counted from the start of the file."""
    keys = list(keys)
    if "line_no" not in lines.columns and n > GROUP_LIMIT_ROWS:
        chunks = line_chunks(lines, keys, order)
        # A chunk that ends before the last n lines holds nothing of the tail.
        late = chunks.starts.withColumn("_cut", F.col("file_lines") - n)
        return (chunks.numbered(late, keep=["_cut"])
                .where(F.col("line_no") > F.col("_cut")).drop("_cut", "start_byte"))
    # One struct as the key: it is hashed once for every step, and null keys match.
    packed = lines.withColumn(KEY, F.struct(*keys)).drop(*keys)
    columns = [F.col(f"{KEY}.`{c}`") if c in keys else F.col(c) for c in lines.columns]
    if "line_no" in lines.columns:
        last = packed.groupBy(KEY).agg(F.max("line_no").alias("_last"))
        return packed.join(last, KEY).where(F.col("line_no") > F.col("_last") - n).select(*columns)
    counts = packed.groupBy(KEY).agg(F.count(F.lit(1)).alias("_last"))
    ranked = first_n(packed, [KEY], order, n, rank="_back", last=True)
    return ranked.join(counts, KEY).select(
        *columns, (F.col("_last") - F.col("_back") + 1).alias("line_no"))
