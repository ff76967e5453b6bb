"""Positions in a merge by zone maps, against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import zones

SCHEMA = "sel_idx int, line_no bigint, ts_key string, line string"


def sources(seed, n=6):
    """Sources in order, one without timestamps, one out of order, one that holds most lines, and ties between them."""
    rng, rows = random.Random(seed), []
    for s in range(n):
        size = 900 if s == 2 else rng.randint(0, 200)
        keys = [f"2024-01-01T00:{rng.randrange(60):02d}:{rng.randrange(60):02d}" for _ in range(size)]
        if s == 1:
            keys = [""] * size
        elif s != 3:
            keys.sort()
        rows += [(s, i + 1, k, f"{s}/{i}") for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    return [(i + 1, r[3]) for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0], r[1])))]


def got(df):
    return sorted((r.pos, r.line) for r in df.collect())


@pytest.mark.parametrize("seed, per_zone, per_range", [(1, 20, 50), (2, 7, 30), (3, 1000, 100), (4, 50, 10_000), (5, 10, 5)])
def test_positions(spark, seed, per_zone, per_range):
    rows = sources(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(zones.merge_by_zones(frame, rows_per_zone=per_zone, rows_per_range=per_range)) == expected(rows)


def test_ranges_are_even_though_most_lines_have_no_timestamp(spark):
    rows = [(s, i + 1, "" if i % 10 else f"2024-01-01T00:00:{i % 60:02d}", f"{s}/{i}") for s in range(4) for i in range(2000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = zones.merge_by_zones(frame, rows_per_zone=100, rows_per_range=500)
    assert got(out) == expected(rows)
    known = zones.zone_map(frame, ["sel_idx"], 100)
    cuts = [tuple(r.cut) for r in zones.range_cuts(known, 500).orderBy("at").collect()]
    held = [0] * (len(cuts) + 1)
    for r in rows:
        held[sum(cut <= (r[2], r[0], r[1]) for cut in cuts)] += 1
    assert len(held) >= 10 and max(held) <= 1_400


def test_a_stored_map_is_read_instead_of_the_lines(spark, tmp_path):
    rows = sources(7)
    frame = spark.createDataFrame(rows, SCHEMA)
    zones.zone_map(frame, ["sel_idx"], 25).write.parquet(str(tmp_path / "zones"))
    stored = spark.read.parquet(str(tmp_path / "zones"))
    assert got(zones.merge_by_zones(frame, zones=stored, rows_per_zone=25, rows_per_range=60)) == expected(rows)


def test_neither_sample_nor_global_sort_nor_cross_join(spark):
    frame = spark.createDataFrame(sources(8), SCHEMA)
    out = zones.merge_by_zones(frame, rows_per_zone=20, rows_per_range=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("rangepartitioning", "Sample", "NestedLoop", "Cartesian"))


def test_null_sources_and_empty_input(spark):
    rows = [(None, 1, "b" * 10, "x"), (None, 2, "a" * 10, "y"), (1, 1, "a" * 10, "z")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(zones.merge_by_zones(frame, rows_per_zone=1, rows_per_range=1)) == [(1, "y"), (2, "z"), (3, "x")]
    assert zones.merge_by_zones(frame.limit(0)).collect() == []
    assert zones.merge_by_zones(frame.withColumn("f", F.lit("a")), ["sel_idx", "f"], rows_per_zone=1, rows_per_range=1).count() == 3
