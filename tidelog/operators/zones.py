"""The timestamp merge of many sources by zone maps.

A zone is a stretch of consecutive lines of one source; its row in the zone map holds the least and the largest merge key
in it and its number of lines, and can be stored with the lines. Ranges of the merge are cut where zones begin, so that
each holds about as many lines, and a zone knows which few cuts lie inside it. A line finds its range by those alone; a
task then gets one range, which is made of few stretches that are in order already, and sorts them together. There is no
sampling pass and no global sort, and where a range begins follows from the zone map and from the zones that a cut goes
through.

Keys are (timestamp key, source, line number): lines without a timestamp, which all have the same first part, are cut like
any others, so they never end in one task. A source whose lines are not in order has zones that reach over many ranges;
its lines find their range by binary search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordinals
from .sizes import keep_small

RANGE_ROWS = 1 << 20
MAX_RANGES = 20_000
FEW_CUTS = 8
ZONE, RANGE = "_zone", "_range"


def merge_key(source: Sequence[str]) -> Column:
    return F.struct("ts_key", *source, "line_no")


def zone_map(lines: DataFrame, source: Sequence[str], rows_per_zone: int | None = None) -> DataFrame:
    """(source, _zone, low, high, rows) of lines that have ``ts_key`` and ``line_no``."""
    zone = F.floor((F.col("line_no") - 1) / (rows_per_zone or ordinals.ROWS_PER_CHUNK))
    key = merge_key(source)
    return lines.groupBy(*source, zone.alias(ZONE)).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows"))


def range_cuts(zones: DataFrame, rows_per_range: int | None = None) -> DataFrame | None:
    """(at, cut): the keys at which the ranges of the merge begin, numbered from 1; None for a single range.

    A cut is the first key of a zone; a new range begins once the zones before it hold enough lines. There are at most
    ``MAX_RANGES`` of them.
    """
    total = zones.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    per_range = max(rows_per_range or RANGE_ROWS, -(-total // MAX_RANGES))
    if total <= per_range:
        return None
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a row per zone, not per line
    filled = zones.select("low", F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / per_range).alias("of"))
    cuts = filled.where("of > 0").groupBy("of").agg(F.min("low").alias("cut"))
    return keep_small(cuts.select(F.row_number().over(Window.orderBy("cut")).alias("at"), "cut"))


def with_ranges(zones: DataFrame, source: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Zones with their first and last range, and the cuts in between, in order: one for most, none for many."""
    ids = [*source, ZONE]
    marks = cuts.select(F.col("cut").alias("key"), F.lit(0).alias("kind")).unionByName(
        zones.select(*ids, F.explode(F.array(F.struct(F.col("low").alias("key"), F.lit(1).alias("kind")),
                                             F.struct(F.col("high").alias("key"), F.lit(2).alias("kind")))).alias("m"))
        .select(*ids, "m.*"), allowMissingColumns=True)
    passed = F.count_if(F.col("kind") == 0).over(Window.orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    ends = marks.withColumn("passed", passed).where("kind > 0").groupBy(*ids).agg(
        F.min("passed").cast("int").alias("first"), F.max("passed").cast("int").alias("last"))
    inner = ends.where("first < last").select(*ids, F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("at"))
    own = inner.join(cuts, "at").groupBy(*ids).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "cut"))),
                                                               lambda x: x["cut"]).alias("own"))  # at most MAX_RANGES
    return _joined(_joined(zones, ends, ids), own, ids, "left")


def _joined(a: DataFrame, b: DataFrame, ids: list[str], how: str = "inner") -> DataFrame:
    """Join in which null ids are equal."""
    renamed = b.select(*[F.col(c).alias(f"_r_{c}") for c in ids], *[c for c in b.columns if c not in ids])
    return a.join(renamed, _all([F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in ids]), how).drop(*[f"_r_{c}" for c in ids])


def _passed(cuts: Column, key: Column) -> Column:
    """How many of the sorted ``cuts`` are at or below a key."""
    few = F.size(F.filter(cuts, lambda cut: cut <= key))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MAX_RANGES.bit_length()))])

    def advance(at: Column, step: Column) -> Column:
        here = F.get(cuts, at + step - 1)
        return F.when(here.isNotNull() & (here <= key), at + step).otherwise(at)

    return F.when(F.size(cuts) <= FEW_CUTS, few).otherwise(F.aggregate(steps, F.lit(0), advance))


def merge_by_zones(lines: DataFrame, source: Sequence[str] = ("sel_idx",), zones: DataFrame | None = None,
                   rows_per_zone: int | None = None, rows_per_range: int | None = None) -> DataFrame:
    """``lines`` with ``pos``, the 1-based position in the order (ts_key, source, line_no), which must be unique.

    ``zones`` is the zone map of exactly these lines if it is stored; it is then read instead of the lines.
    """
    source = list(source)
    zones = keep_small(zone_map(lines, source, rows_per_zone) if zones is None else zones)
    cuts = range_cuts(zones, rows_per_range)
    order = ["ts_key", *source, "line_no"]
    if cuts is None:
        return lines.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # at most one range
    known = keep_small(with_ranges(zones, source, cuts))
    zone = F.floor((F.col("line_no") - 1) / (rows_per_zone or ordinals.ROWS_PER_CHUNK))
    tagged = _joined(lines.withColumn(ZONE, zone), known.select(*source, ZONE, "first", "own"), [*source, ZONE])
    columns = [F.col(c) for c in lines.columns]
    beyond = F.when(F.col("own").isNotNull(), _passed(F.col("own"), merge_key(source))).otherwise(0)
    placed = tagged.select(*columns, "own", (F.col("first") + beyond).alias(RANGE))
    counted = known.where("own is null").select(F.col("first").alias(RANGE), "rows").unionByName(
        placed.where("own is not null").select(RANGE, F.lit(1).cast("bigint").alias("rows")))
    sizes = counted.groupBy(RANGE).agg(F.sum("rows").alias("rows"))
    starts = sizes.select(F.col(RANGE).alias("_at"), F.coalesce(F.sum("rows").over(
        Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row per range
    inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order))
    numbered = placed.drop("own").withColumn("_inside", inside).join(starts, F.col(RANGE) == F.col("_at"))
    return numbered.select(*columns, (F.col("_start") + F.col("_inside")).cast("bigint").alias("pos"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
