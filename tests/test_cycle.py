"""Whole collection cycles: node files and landed API answers end in one run."""

import os
from datetime import datetime, timedelta, timezone

from tidelog.sources import state, tables
from tidelog.sources.sinks import drop_runs
from tidelog.streaming.cycle import ApiPhase, Store, archive_new_runs, collect, reopen

LINES = "ns string, pod string, container string, ts timestamp, line string, seq bigint"


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def stored(spark, store):
    return sorted((r.run, r.filename.split("__", 3)[1], ".previous" in r.filename, r.line)
                  for r in tables.log_lines(spark, store.lines).collect())


def test_both_phases_end_in_one_run_and_no_line_comes_twice(spark, tmp_path):
    logs, store = str(tmp_path / "logs"), Store(str(tmp_path / "store"))
    now = datetime(2024, 1, 5, 8, tzinfo=timezone.utc)
    write(f"{logs}/ns_plain_u/c/0.log", b"node 1\nnode 2\n")
    write(f"{logs}/ns_turned_u/c/0.log", b"after\n")
    write(f"{logs}/ns_turned_u/c/0.log.1", b"before\n")

    def answer(pod, texts, start):
        return [("ns", pod, "c", start + timedelta(seconds=i), t, i) for i, t in enumerate(texts)]

    def api(current, previous):
        return ApiPhase(spark.createDataFrame(current, LINES), spark.createDataFrame(previous, LINES),
                        spark.createDataFrame([("ns", p, "c") for p in ("plain", "turned", "remote")],
                                              "ns string, pod string, containers string"))

    early = now - timedelta(seconds=20)
    current = answer("remote", ["same", "other"], early) + answer("plain", ["node 1"], early) + answer("turned", ["after"], early)
    current.insert(1, ("ns", "remote", "c", early, "same", 5))  # logged twice in one moment
    previous = answer("turned", ["crash"], early) + answer("plain", ["unasked"], early) + answer("remote", ["unasked"], early)
    first = collect(spark, logs, store, api(current, previous), now)
    assert stored(spark, store) == sorted([
        (first, "plain", False, "node 1"), (first, "plain", False, "node 2"), (first, "turned", False, "before"),
        (first, "turned", False, "after"), (first, "turned", True, "crash"), (first, "remote", False, "same"),
        (first, "remote", False, "same"), (first, "remote", False, "other")])
    assert tables.runs(spark, store.runs).first().file_count == 4
    assert state.read_last_run(spark, store.last_run) == now

    # Nothing new on the node; the answer overlaps the last one.
    later = now + timedelta(hours=4)
    current += answer("remote", ["late", "other"], now + timedelta(hours=1))
    os.utime(f"{logs}/ns_turned_u/c/0.log.1", (0, 0))
    second = collect(spark, logs, store, api(current, previous), later)
    assert [x for x in stored(spark, store) if x[0] == second] == sorted(
        [(second, "remote", False, "late"), (second, "remote", False, "other")])
    assert collect(spark, logs, store, api(current, previous), later + timedelta(hours=4)) is None


def test_a_cycle_without_the_api(spark, tmp_path):
    logs, store = str(tmp_path / "logs"), Store(str(tmp_path / "store"))
    write(f"{logs}/ns_p_u/c/0.log", b"x\n")
    assert collect(spark, logs, store) is not None and collect(spark, logs, store) is None


def test_a_dropped_run_is_read_from_its_archive(spark, tmp_path):
    logs, store = str(tmp_path / "logs"), Store(str(tmp_path / "store"))
    write(f"{logs}/ns_p_u/c/0.log", b"first\nsecond\r\nthird\n")
    write(f"{logs}/ns_q_u/c/0.log", b"other\n")
    run = collect(spark, logs, store, reread_guard="9 hours")
    before = sorted(tuple(r) for r in tables.log_lines(spark, store.lines).select("run", "filename", "line_no", "start_byte", "n_bytes", "line").collect())
    assert archive_new_runs(spark, store) == [run] and archive_new_runs(spark, store) == []
    assert tables.archives(spark, store.archives).first().size_bytes > 0
    drop_runs(spark, [run], store.lines, store.files, store.runs)
    assert tables.log_lines(spark, store.lines).count() == 0
    assert sorted(tuple(r) for r in reopen(spark, store).select("run", "filename", "line_no", "start_byte", "n_bytes", "line").collect()) == before
    names = sorted({r[1] for r in before})
    assert [r.line for r in reopen(spark, store, [run], names[1:]).collect()] == ["other"]
    drop_runs(spark, [run], *store.by_run)
    assert reopen(spark, store).count() == 0
