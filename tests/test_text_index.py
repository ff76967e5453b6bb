"""The inverted filter finds the rows of a full scan, and opens no chunk that cannot have them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import text_index as ti
from tidelog.operators.filters import search_lines
from tidelog.sources.folders import delete_folder, shared_folder

SCHEMA = "run string, ns string, filename string, line_no bigint, start_byte bigint, line string"
RUNS = ["2024-01-01_00-00-00", "2024-01-02_00-00-00", "2024-01-03_00-00-00"]


def made(spark, runs, seed=1):
    rng, rows = random.Random(seed), []
    words = ["alpha", "Straße", "größer", "日本語", "İstanbul", "λόγος", "éclair", "😀😁😂", "x", "", "WARN", "12.5%", "a_b"]
    for run in runs:
        for f in range(6):
            at = 0
            for n in range(120):
                line = " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) + (f" token{f}x{run[8:10]}" if n == 60 else "")
                rows.append((run, f"ns{f % 2}", f"f{f}.log", n + 1, at, line))
                at += len(line.encode()) + 1
    return spark.createDataFrame(rows, SCHEMA)


def build(spark):
    lines = made(spark, RUNS).repartition(5)
    store = ti.IndexedLines(shared_folder(spark), lines.schema)
    ti.write_indexed_lines(lines, store, ["filename", F.floor(F.col("start_byte") / 1024)], chunk_bytes=4096)
    return lines, store


@pytest.fixture(scope="module")
def stored(spark):
    return build(spark)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def opened(df):
    return sorted({os.path.dirname(f).split("/lines/")[1] for f in df.inputFiles()})


QUERIES = ["alpha", "ALPHA", "straße", "STRASSE", "größ", "日本語", "本語", "İSTANBUL", "istanbul", "λόγοσ", "ΛΌΓΟΣ", "écl", "😀😁😂", "😁",
           "x", " x ", "12.5%", "%", "a_b", "token3x02", "not there at all", "alpha\n"]


@pytest.mark.parametrize("query", QUERIES)
def test_rows_of_a_full_scan(spark, stored, query):
    lines, store = stored
    assert rows(ti.search_indexed_lines(spark, store, query)) == rows(search_lines(lines, query))


def test_run_and_namespace_predicates(spark, stored):
    lines, store = stored
    wanted = ("alpha", ["ns1"], "2024-01-02", "2024-01-02")
    found = ti.search_indexed_lines(spark, store, *wanted)
    assert rows(found) == rows(search_lines(lines, *wanted)) != []
    assert all(f.startswith("run=2024-01-02") for f in opened(found))


def test_only_chunks_that_may_match_are_opened(spark, stored):
    lines, store = stored
    every = opened(ti.search_indexed_lines(spark, store, "x"))
    assert len(every) > 8
    found = ti.search_indexed_lines(spark, store, "token3x02")
    assert len(opened(found)) == 1 and opened(found)[0].startswith("run=2024-01-02") and found.count() == 1
    assert opened(ti.search_indexed_lines(spark, store, "not there at all")) == []


def test_more_chunks_than_are_named(spark, stored, monkeypatch):
    lines, store = stored
    monkeypatch.setattr(ti, "MAX_PATHS", 2)
    assert rows(ti.search_indexed_lines(spark, store, "alpha")) == rows(search_lines(lines, "alpha"))


def test_runs_are_replaced_one_by_one(spark):
    lines, store = build(spark)
    again = made(spark, RUNS[1:2], seed=2).where("line_no < 50")
    ti.write_indexed_lines(again, store, ["filename"], chunk_bytes=2048)
    both = lines.where(F.col("run") != RUNS[1]).unionByName(again)
    for query in ("größer", "token3x02", "x"):
        assert rows(ti.search_indexed_lines(spark, store, query)) == rows(search_lines(both, query))


def test_a_stopped_update_hides_nothing(spark, monkeypatch):
    """Lines written, the filter not: the run is read whole until its filter is there."""
    lines, store = build(spark)
    again = made(spark, RUNS[1:2], seed=3)
    both = lines.where(F.col("run") != RUNS[1]).unionByName(again)

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ti, "index_runs", stop)
    with pytest.raises(KeyboardInterrupt):
        ti.write_indexed_lines(again, store, ["filename"])
    monkeypatch.undo()
    for step in (lambda: None, lambda: ti.index_runs(spark, store, [RUNS[1]]), lambda: delete_folder(spark, store.grams)):
        step()
        for query in ("größer", "token3x02", "token3x03"):
            assert rows(ti.search_indexed_lines(spark, store, query)) == rows(search_lines(both, query))


def test_one_task_for_a_hot_file_is_not_needed(spark):
    """A single file of many lines is dealt to as many chunks as its bytes need."""
    lines = spark.range(40_000).select(F.lit(RUNS[0]).alias("run"), F.lit("ns").alias("ns"), F.lit("hot.log").alias("filename"),
                                       (F.col("id") + 1).alias("line_no"), (F.col("id") * 30).alias("start_byte"),
                                       F.format_string("line number %d of the file", F.col("id")).alias("line"))
    store = ti.IndexedLines(shared_folder(spark), lines.schema)
    ti.write_indexed_lines(lines, store, ["filename", F.shiftright("start_byte", 14)], chunk_bytes=1 << 16)
    found = ti.search_indexed_lines(spark, store, "number 12345 ")
    chunks = len(opened(ti.search_indexed_lines(spark, store, "li")))
    assert found.count() == 1 and chunks > 10 and len(opened(found)) <= chunks // 2


def test_empty_input_and_lines_without_text(spark):
    lines = made(spark, RUNS[:1]).limit(0)
    store = ti.IndexedLines(shared_folder(spark), lines.schema)
    assert ti.write_indexed_lines(lines, store, ["filename"]) == []
    assert rows(ti.search_indexed_lines(spark, store, "alpha")) == []
    odd = spark.createDataFrame([(RUNS[0], "n", "f", 1, 0, None), (RUNS[0], "n", "f", 2, 1, ""), (RUNS[0], "n", "f", 3, 2, "ab")], SCHEMA)
    ti.write_indexed_lines(odd, store, ["filename"])
    assert rows(ti.search_indexed_lines(spark, store, "abc")) == []
    assert [r.line for r in ti.search_indexed_lines(spark, store, "ab").collect()] == ["ab"]


def test_invalid_bytes(spark):
    line = F.concat(F.lit("start "), F.unhex(F.lit("e4")).cast("string"), F.lit("éclair end"))
    lines = spark.range(3).select(F.lit(RUNS[0]).alias("run"), F.lit("n").alias("ns"), F.lit("f").alias("filename"),
                                  F.col("id").alias("line_no"), F.lit(0).cast("bigint").alias("start_byte"), line.alias("line"))
    store = ti.IndexedLines(shared_folder(spark), lines.schema)
    ti.write_indexed_lines(lines, store, ["filename"])
    assert ti.search_indexed_lines(spark, store, "éclair").count() == search_lines(lines, "éclair").count() == 3
