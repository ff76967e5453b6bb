"""Runs, files, lines and archives change together, and the summary follows by what changes."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators.catalog import dashboard_stats, index_files
from tidelog.schemas import ARCHIVES, LOG_LINES
from tidelog.sources.run_store import RunStore


def run(n):
    return f"2024-01-{n:02d}_00-00-00"


def lines(spark, runs, files=2, count=5, word="info"):
    rows = [(run(r), f"ns{f}", "pod", "u", "app", f"f{f}__{run(r)}.log", i + 1, i * 10, 9, f"{word} {r}.{i}", "", None)
            for r in runs for f in range(files) for i in range(count)]
    return spark.createDataFrame(rows, LOG_LINES)


def archives(spark, runs):
    return spark.createDataFrame([(f"archive_{run(r)}.tar.gz", run(r), 100 + r, None) for r in runs], ARCHIVES)


def state(store):
    """What a reader sees, after checking that its parts agree."""
    got = store.lines().collect()
    files = sorted(tuple(r) for r in store.files().collect())
    assert files == sorted(tuple(r) for r in index_files(store.lines()).select(*store.files().columns).collect())
    runs = {r.run: (r.file_count, r.total_bytes) for r in store.runs().collect()}
    assert runs == {r: (sum(f[0] == r for f in files), sum(f[5] for f in files if f[0] == r)) for r in {f[0] for f in files}}
    assert {r.run for r in store.archives().collect()} <= set(runs)
    full = dashboard_stats(store.runs(), store.archives()).first()
    assert store.dashboard_stats().first().asDict() == full.asDict()
    return sorted((r.run, r.filename, r.line_no, r.line) for r in got), sorted(r.run for r in store.archives().collect())


def test_put_replace_archive_drop(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    assert state(store) == ([], [])
    assert store.put(lines(spark, [1, 2, 3])) == [run(1), run(2), run(3)]
    store.set_archives(archives(spark, [1, 3, 9]))  # the last one has no run
    assert state(store)[1] == [run(1), run(3)]
    store.put(lines(spark, [2], files=1, count=3, word="error"))
    now, _ = state(store)
    assert [x[3] for x in now if x[0] == run(2)] == ["error 2.0", "error 2.1", "error 2.2"]
    store.drop([run(3), run(7)])
    now, kept = state(store)
    assert {x[0] for x in now} == {run(1), run(2)} and kept == [run(1)]
    assert store.dashboard_stats().first().last_run == run(2)
    assert [r.run for r in store.lines("2024-01-02", "2024-01-05").select("run").distinct().collect()] == [run(2)]
    store.drop([run(1), run(2)])
    assert state(store) == ([], []) and store.dashboard_stats().first().last_run == "Never"
    assert store.put(lines(spark, []).limit(0)) == []


STEPS = ["lines", "files", "runs", "summary", "mark"]


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_stopped_after_any_step_changes_nothing_or_all(spark, tmp_path, step, monkeypatch):
    store = RunStore(spark, str(tmp_path / "s"))
    store.put(lines(spark, [1, 2]))
    before = state(store)
    writer, seen = type(spark.range(1).write), []
    original, mark = writer.parquet, RunStore._mark

    def write(self, path, *args, **kwargs):
        original(self, path, *args, **kwargs)
        seen.append(path.rpartition("/")[2])
        if seen[-1] == step:
            raise KeyboardInterrupt

    def marked(self, version):
        mark(self, version)
        if step == "mark":
            raise KeyboardInterrupt

    monkeypatch.setattr(writer, "parquet", write)
    monkeypatch.setattr(RunStore, "_mark", marked)
    with pytest.raises(KeyboardInterrupt):
        store.put(lines(spark, [2, 3], count=4, word="warn"))
    monkeypatch.undo()
    after = state(store)
    if step == "mark":
        assert {x[0] for x in after[0]} == {run(1), run(2), run(3)}
    else:
        assert after == before
    store.put(lines(spark, [2, 3], count=4, word="warn"))  # the same again
    assert [x[3] for x in state(store)[0] if x[0] == run(2)][:1] == ["warn 2.0"]
    store.vacuum(1)
    assert {x[0] for x in state(store)[0]} == {run(1), run(2), run(3)}
    assert len(list((tmp_path / "s" / "attempts").iterdir())) == 2 and len(list((tmp_path / "s" / "versions").iterdir())) == 1


def test_the_summary_follows_any_order_of_changes(spark, tmp_path):
    rng, store = random.Random(3), RunStore(spark, str(tmp_path / "s"))
    for _ in range(7):
        some = rng.sample(range(1, 7), rng.randint(1, 3))
        kind = rng.choice(["put", "put", "drop", "archive"])
        if kind == "put":
            store.put(lines(spark, some, rng.randint(1, 3), rng.randint(1, 4)))
        elif kind == "drop":
            store.drop([run(r) for r in some])
        else:
            store.set_archives(archives(spark, some))
        full = dashboard_stats(store.runs(), store.archives()).first()
        assert store.dashboard_stats().first().asDict() == full.asDict()
    assert "Aggregate" not in store.dashboard_stats()._jdf.queryExecution().executedPlan().toString()
    assert store.dashboard_stats().where(F.col("runs") >= 0).count() == 1


def test_a_stream_fills_the_store_run_by_run(spark, tmp_path):
    from tidelog.streaming.pipelines import start_store_ingest

    folder = tmp_path / "logs" / "ns_pod_uid" / "app"
    folder.mkdir(parents=True)
    store, log = RunStore(spark, str(tmp_path / "s")), folder / "0.log"

    def collect():
        start_store_ingest(spark, str(tmp_path / "logs"), store, str(tmp_path / "cp"), now=True, reread_guard="9 hours").awaitTermination()
        now, _ = state(store)
        return [x[3] for x in now]

    log.write_text("one\ntwo\n")
    assert collect() == ["one", "two"]
    with log.open("a") as f:
        f.write("three\n")
    assert collect() == ["one", "two", "three"] and store.runs().count() == 2
    assert collect() == ["one", "two", "three"] and store.runs().count() == 2
