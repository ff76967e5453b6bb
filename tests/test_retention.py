"""Retention in closed form against the loop it stands for."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.operators import retention


def loop(sizes, threshold, current):
    used, dropped = sum(sizes.values()), set()
    for run in sorted(r for r in sizes if r != current):
        if used < threshold:
            break
        used -= sizes[run]
        dropped.add(run)
    return dropped


def test_capacity_cleanup_equals_the_loop(spark):
    rng = random.Random(3)
    for case in range(25):
        at, sizes = datetime(2024, 1, 1), {}
        for _ in range(rng.randrange(1, 40)):
            at += timedelta(seconds=rng.choice([1, 60, 14_400, 90_000]))
            sizes[at.strftime("%Y-%m-%d_%H-%M-%S")] = rng.choice([0, 5, 100, rng.randrange(1_000)])
        threshold = rng.choice([0, 1, sum(sizes.values()) // 2, sum(sizes.values()), 10**9])
        current = rng.choice([None, max(sizes), min(sizes)])
        df = spark.createDataFrame(list(sizes.items()), "run string, size_bytes bigint")
        got = retention.capacity_cleanup(df, F.lit(threshold), current).where("dropped").collect()
        assert {r.run for r in got} == loop(sizes, threshold, current or max(sizes)), case


def test_capacity_cleanup_can_be_off(spark):
    df = spark.createDataFrame([("2024-01-01_00-00-00", 5), ("2024-01-02_00-00-00", 5)], "run string, size_bytes bigint")
    off = retention.capacity_threshold(F.lit(10), 0)
    assert retention.capacity_cleanup(df, off).where("dropped").count() == 0
    assert retention.capacity_cleanup(df, retention.capacity_threshold(F.lit(10), 80)).where("dropped").count() == 1


def test_threshold_of_very_large_stores(spark):
    row = spark.range(1).select(retention.capacity_threshold(F.lit(150 * 1024**3), 80).alias("a"),
                                retention.capacity_threshold(F.lit(2**60), 75).alias("b"),
                                retention.capacity_threshold(F.lit(7), 50).alias("c")).first()
    assert tuple(row) == (int(150 * 1024**3 * 80 / 100), int(2**60 * 75 / 100), 3)


@pytest.mark.parametrize("max_drop", [1, 2, 10])
def test_retention_drops_the_oldest_first(spark, max_drop):
    now = datetime(2024, 3, 1)
    ages = [40, 10, 35, 90, 30]
    rows = [(f"run{i}", now - timedelta(days=a)) for i, a in enumerate(ages)] + [(".hidden", now - timedelta(days=99))]
    runs = spark.createDataFrame(rows, "run string, created_at timestamp")
    expired = retention.expired_runs(runs, F.lit(now))
    assert {r.run for r in expired.collect()} == {"run0", "run2", "run3"}
    got = [r.run for r in retention.retention_next(runs, F.lit(now), max_drop=max_drop).collect()]
    assert got == ["run3", "run0", "run2"][:max_drop]


def test_storage_usage(spark):
    files = spark.createDataFrame([(700,), (299,)], "size_bytes bigint")
    archives = spark.createDataFrame([(1,)], "size_bytes bigint")
    assert retention.storage_usage(files, archives, F.lit(1_500)).first().used_pct == 66
    assert retention.storage_usage(files, archives, F.lit(0)).first().used_pct == 0
