"""Numbering, first/last-N: against plain Python, with a hot key, null keys and tied timestamps."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.functions.times import epoch_micros
from tidelog.operators import ordinals
from tidelog.operators.ordinals import (CHUNK, KEY, chunk_bounds, head_lines, line_chunks, number_lines,
                                        tail_lines)

N = 3_000


def rows():
    rng = random.Random(5)
    out = []
    for i in range(N):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        # A third of all lines share one timestamp.
        ts = datetime(2024, 1, 1) + (timedelta() if rng.random() < 0.33 else timedelta(microseconds=rng.randrange(10**9)))
        out.append((key, ts, i, rng.randrange(1, 90)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "k string, ts timestamp, id bigint, size int").repartition(5)


def expected(data):
    out, number, start = {}, {}, {}
    for key, ts, i, size in sorted(data, key=lambda r: (r[1], r[2])):
        number[key] = number.get(key, 0) + 1
        out[i] = (number[key], start.get(key, 0))
        start[key] = start.get(key, 0) + size
    return out


@pytest.mark.parametrize("per_chunk", [1, 7, 100, 10**6])
def test_number_lines_equals_a_plain_loop(table, data, per_chunk):
    got = number_lines(table, ["k"], ["ts", "id"], F.col("size"), rows_per_chunk=per_chunk)
    assert {r.id: (r.line_no, r.start_byte) for r in got.collect()} == expected(data)


def test_a_hot_key_is_cut_into_bounded_chunks(table):
    bounds = chunk_bounds(table, ["ts", "id"], rows_per_chunk=100)
    chunks = line_chunks(table, ["k"], ["ts", "id"], bounds=bounds)
    largest = chunks.rows.groupBy(KEY, CHUNK).count().agg(F.max("count")).first()[0]
    assert largest <= 300


def test_string_order_and_no_key(table, data):
    text = table.withColumn("word", F.lpad(F.col("id").cast("string"), 6, "0"))
    got = number_lines(text, [], ["word"], rows_per_chunk=50).collect()
    assert all(r.line_no == r.id + 1 for r in got) and len(got) == N


def test_bounds_over_leading_columns(table, data):
    bounds = chunk_bounds(table, ["ts"], rows_per_chunk=100)
    got = number_lines(table, ["k"], ["ts", "id"], F.col("size"), bounds=bounds)
    assert {r.id: (r.line_no, r.start_byte) for r in got.collect()} == expected(data)


@pytest.mark.parametrize("n", [1, 5, 200, 1_001])
def test_head_and_tail(table, data, n, monkeypatch):
    monkeypatch.setattr(ordinals, "ROWS_PER_CHUNK", 64)
    places = expected(data)
    sizes = {}
    for key, *_ in data:
        sizes[key] = sizes.get(key, 0) + 1
    head = head_lines(table, n, ["k"], ["ts", "id"])
    assert {r.id: r.line_no for r in head.collect()} == {i: p[0] for i, p in places.items() if p[0] <= n}
    tail = tail_lines(table, n, ["k"], ["ts", "id"])
    key_of = {r[2]: r[0] for r in data}
    assert {r.id: r.line_no for r in tail.collect()} == {
        i: p[0] for i, p in places.items() if p[0] > sizes[key_of[i]] - n}
    stored = number_lines(table, ["k"], ["ts", "id"])
    assert {r.id for r in head_lines(stored, n, ["k"]).collect()} == {r.id for r in head.collect()}
    assert {r.id for r in tail_lines(stored, n, ["k"]).collect()} == {r.id for r in tail.collect()}


def test_first_n_prunes_before_the_shuffle(table):
    plan = head_lines(table, 5, ["k"], ["ts", "id"])._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[first_exchange:]


def test_numbering_never_orders_a_whole_file_in_one_task(table):
    plan = number_lines(table, ["k"], ["ts", "id"], F.col("size"), rows_per_chunk=100)
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in text.splitlines() if "Window [row_number()" in x]
    assert lines and all(CHUNK in x for x in lines)


def test_timestamps_without_zone_ignore_the_session_zone(spark):
    """A clock change in the session's zone neither reorders nor merges local times."""
    at = datetime(2024, 3, 10, 1, 0)
    rows = [(i, at + timedelta(minutes=i, microseconds=i)) for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz").repartition(3)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = number_lines(df, [], ["ts"], rows_per_chunk=7).collect()
        assert all(r.line_no == r.id + 1 for r in got) and len(got) == 240
        micros = df.select("id", epoch_micros(F.col("ts"), "timestamp_ntz").alias("m")).collect()
        assert all(r.m == round((rows[r.id][1] - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for r in micros)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
