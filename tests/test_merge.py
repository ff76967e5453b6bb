"""The timestamp merge against a stable sort of plain lists."""

import random
import re

import pytest

from tidelog.operators import merge, sizes

RUN = "2024-01-01_00-00-00"


def key(line):
    found = re.match(r"[^ ]{10,}", line)
    return found[0] if found else ""


@pytest.fixture(scope="module")
def files():
    rng = random.Random(8)
    out = {}
    for i in range(5):
        lines = []
        for n in range(rng.randrange(30, 60)):
            lines.append(f"2024-01-01T00:00:{rng.randrange(20):02d}.000Z INFO line {n}" if rng.random() < 0.8
                         else f"  at frame {n}")
        out[f"ns__pod{i}__app__{RUN}.log"] = lines
    return out


@pytest.fixture(scope="module")
def lines(spark, files):
    rows = [(RUN, f, n + 1, line) for f, content in files.items() for n, line in enumerate(content)]
    return spark.createDataFrame(rows, "run string, filename string, line_no bigint, line string").repartition(4)


@pytest.mark.parametrize("tail", [None, 10])
@pytest.mark.parametrize("carry", [False, True])
def test_merge_is_a_stable_sort(spark, files, lines, tail, carry):
    chosen = list(files) + [next(iter(files)), "missing.log"]
    selection = merge.make_selection(spark, [RUN] * len(chosen), chosen)
    want = []
    for i, name in enumerate(chosen):
        content = files.get(name, [])
        last = ""
        for line in content[-tail:] if tail else content:
            last = key(line) or (last if carry else "")
            want.append((last, i, line))
    want = [(i, line) for _, i, line in sorted(want, key=lambda x: x[0])]
    merged = merge.merge_sources(lines, selection, tail, carry_forward=carry)
    assert [(r.sel_idx, r.line) for r in merge.merge_order(merged).collect()] == want
    for bound in (None, 70_000, 500):
        placed = merge.merge_positions(merged, bound).orderBy("pos").collect()
        assert [(r.sel_idx, r.line) for r in placed] == want
        assert [r.pos for r in placed] == list(range(1, len(want) + 1))
    summary = merge.merge_summary(merged).first()
    assert (summary.total_lines, summary.sources) == (len(want), 6)


def test_carry_over_chunk_borders(spark):
    rows = [("f", 1, "k1"), ("f", 2, ""), ("f", 3, ""), ("f", 4, ""), ("f", 5, "k5"), ("f", 6, ""), ("g", 1, "")]
    df = spark.createDataFrame(rows, "filename string, line_no bigint, ts_key string")
    got = merge.carry_timestamps(df, ["filename"], rows_per_chunk=2).orderBy("filename", "line_no").collect()
    assert [r.ts_key for r in got] == ["k1", "k1", "k1", "k1", "k5", "k5", ""]


def test_live_filter_sees_the_label(spark, lines, files):
    name = next(iter(files))
    merged = merge.merge_sources(lines, merge.make_selection(spark, [RUN], [name]), None)
    assert merge.visible_lines(merged, "[POD0/APP] 2024").count() == sum(x.startswith("2024") for x in files[name])
    assert merge.visible_lines(merged, "").count() == len(files[name])


def test_selection_lists_must_match(spark):
    with pytest.raises(ValueError):
        merge.make_selection(spark, ["a"], [])


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_selections_are_broadcast_only_when_small(spark, lines, files, monkeypatch):
    selection = merge.make_selection(spark, [RUN] * 3, [*files][:3])
    assert "BroadcastHashJoin" in joins(merge.selected_lines(lines, selection))
    monkeypatch.setattr(merge, "keep_small", lambda df: sizes.keep_small(df, 2))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        large = merge.selected_lines(lines, selection)
        assert "SortMergeJoin" in joins(large) and "Broadcast" not in joins(large)
        assert "LocalTableScan" not in joins(large)
        assert large.count() == sum(len(files[f]) for f in [*files][:3])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_keep_small_of_nothing(spark):
    empty = spark.createDataFrame([], "a string, b bigint")
    assert sizes.keep_small(empty).collect() == [] and sizes.keep_small(empty).schema == empty.schema


def test_a_broken_promise_of_rows_is_an_error(spark):
    merged = spark.createDataFrame([("k", 0, i) for i in range(5)], "ts_key string, sel_idx int, line_no bigint")
    assert merge.merge_positions(merged, 5).count() == 5
    with pytest.raises(Exception, match="more than the 4 rows"):
        merge.merge_positions(merged, 4).collect()
