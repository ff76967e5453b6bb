"""The tailing source: growth, rotation, truncation, unfinished lines, restart, byte ranges."""

import gzip
import os
from datetime import datetime, timedelta

import pytest

from tidelog.operators import catalog
from tidelog.operators.filters import pattern_count_by_run
from tidelog.sources import sinks, tables
from tidelog.sources.tail import ByteRange, LogTailReader, _owned_lines
from tidelog.streaming.cycle import Store, archive_new_runs, clean_up, collect
from tidelog.sources.text_tree import read_node_logs
from tidelog.streaming import pipelines
from tidelog.streaming.pipelines import drop_reread_lines, start_ingest, tail_stream


def write(path, data, mode="ab"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def batches(reader, start, end):
    lines = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            lines += [(os.path.basename(r["path"]), r["start_byte"], r["line"]) for r in batch.to_pylist()]
    return sorted(lines)


class Steps:
    """Drive a reader by hand: every call is one micro-batch."""

    def __init__(self, root, **options):
        self.reader = LogTailReader({"path": str(root), **options})
        self.at = self.reader.initialOffset()

    def next(self):
        end = self.reader.latestOffset()
        lines = batches(self.reader, self.at, end)
        self.at = end
        return lines


@pytest.fixture
def log(tmp_path):
    return str(tmp_path / "logs" / "ns1_pod-a_uid1" / "app" / "0.log")


def test_growth_truncation_partial_line_and_deletion(tmp_path, log):
    write(log, b"one\ntwo\n")
    steps = Steps(tmp_path / "logs")
    assert steps.next() == [("0.log", 0, "one"), ("0.log", 4, "two")]
    write(log, b"three\nunfin")
    assert steps.next() == [("0.log", 8, "three")]
    assert steps.next() == []
    write(log, b"ished\n")
    assert steps.next() == [("0.log", 14, "unfinished")]
    write(log, b"new\n", "wb")
    assert steps.next() == [("0.log", 0, "new")]
    os.remove(log)
    assert steps.next() == [] and steps.at["files"] == "{}"


def test_rotation_by_rename_continues_the_old_file(tmp_path, log):
    write(log, b"2024-01-01T00:00:00Z a\n2024-01-01T00:00:01Z b\n")
    steps = Steps(tmp_path / "logs")
    assert len(steps.next()) == 2
    write(log, b"2024-01-01T00:00:02Z late\n2024-01-01T00:00:03Z no line end")
    os.rename(log, log + ".20240101")
    write(log, b"2024-01-02T00:00:00Z fresh, and longer than what was read of the file before it\n" * 3)
    got = steps.next()
    assert [x[2][-5:] for x in got if x[0] == "0.log.20240101"] == [" late", "e end"]
    assert len([x for x in got if x[0] == "0.log"]) == 3
    assert steps.next() == []


def squeeze(path):
    with open(path, "rb") as f, gzip.open(path + ".gz", "wb") as z:
        z.write(f.read())


def test_compressed_rotated_files(tmp_path, log):
    write(log, b"2024-01-01T00:00:00Z a\n2024-01-01T00:00:01Z b\n")
    steps = Steps(tmp_path / "logs")
    assert len(steps.next()) == 2
    # Rotated twice and compressed between two listings: one file was seen before, one never.
    write(log, b"2024-01-01T00:00:02Z c\n")
    os.rename(log, log + ".1")
    squeeze(log + ".1")
    os.remove(log + ".1")
    with gzip.open(log + ".2.gz", "wb") as z:
        z.write(b"2024-01-02T00:00:00Z d\n2024-01-02T00:00:01Z open end")
    write(log, b"2024-01-03T00:00:00Z e\n")
    assert [x[2][-1] for x in steps.next()] == ["e", "c", "d", "d"]
    assert steps.next() == []
    # A plain rotated file that was read and is compressed later brings nothing new.
    os.rename(log, log + ".3")
    write(log, b"2024-01-04T00:00:00Z f\n")
    assert [x[2][-1] for x in steps.next()] == ["f"]
    squeeze(log + ".3")
    assert steps.next() == []
    os.remove(log + ".3")
    assert steps.next() == []
    os.remove(log + ".1.gz")
    assert steps.next() == []


def test_an_open_last_line_of_a_rotated_file_comes_once(tmp_path, log):
    write(log, b"first line of this file\nopen end")
    steps = Steps(tmp_path / "logs")
    assert [x[2] for x in steps.next()] == ["first line of this file"]
    os.rename(log, log + ".1")
    assert [x[2] for x in steps.next()] == ["open end"]
    os.rename(log + ".1", log + ".2")
    assert steps.next() == []
    squeeze(log + ".2")
    os.remove(log + ".2")
    assert steps.next() == []
    # Rotated and compressed between two listings: the open line was never seen.
    write(log, b"first line of another file\nopen again")
    assert [x[2] for x in steps.next()] == ["first line of another file"]
    squeeze(log)
    os.rename(log + ".gz", log + ".3.gz")
    os.remove(log)
    assert [x[2] for x in steps.next()] == ["open again"]
    assert steps.next() == []


def test_a_file_replaced_by_a_longer_one_is_read_from_its_start(tmp_path, log):
    write(log, b"first file\n")
    steps = Steps(tmp_path / "logs")
    steps.next()
    write(log, b"second file, longer\nmore\n", "wb")
    assert [x[2] for x in steps.next()] == ["second file, longer", "more"]


def test_an_unchanged_listing_is_the_same_offset(tmp_path, log):
    write(log, b"x\n")
    reader = LogTailReader({"path": str(tmp_path / "logs")})
    first = reader.latestOffset()
    assert reader.latestOffset() == first
    write(log, b"y\n")
    assert reader.latestOffset()["at"] > first["at"]


def test_malformed_directories_and_other_namespaces_are_skipped(tmp_path, log):
    write(log, b"x\n")
    write(str(tmp_path / "logs" / "nounderscore" / "app" / "0.log"), b"no\n")
    write(str(tmp_path / "logs" / "ns2_pod-b_uid2" / "app" / "0.log"), b"other\n")
    write(str(tmp_path / "logs" / "ns1_pod-a_uid1" / "app" / "0.log.1.gz.tmp"), b"\x1f\x8b")
    assert sorted(x[2] for x in Steps(tmp_path / "logs").next()) == ["other", "x"]
    assert [x[2] for x in Steps(tmp_path / "logs", namespaces="ns2").next()] == ["other"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_ranges_cut_anywhere_give_every_line_once(tmp_path, size):
    path = str(tmp_path / "f")
    lines = [b"", b"a", b"bb", b"", b"c" * 40, "é\r".encode(), b"tail"]
    data = b"\n".join(lines) + b"\n" + b"open"
    write(path, data)
    got = []
    for low in range(0, len(data), size):
        high = min(low + size, len(data))
        for starts, sizes, texts in _owned_lines(path, low, high, closed=high == len(data)):
            got += list(zip(starts.tolist(), sizes.tolist(), texts.to_pylist()))
    expected, at = [], 0
    for line in [*lines, b"open"]:
        expected.append((at, len(line), line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    assert got == expected


def test_a_range_is_found_again_after_a_rename_and_missing_data_is_an_error(tmp_path, log):
    write(log, b"kept line\n")
    reader = LogTailReader({"path": str(tmp_path / "logs")})
    part = reader.partitions(reader.initialOffset(), reader.latestOffset())[0]
    os.rename(log, log + ".1")
    write(log, b"other\n")
    assert [r["line"] for b in reader.read(part) for r in b.to_pylist()] == ["kept line"]
    os.remove(log + ".1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))
    relaxed = LogTailReader({"path": str(tmp_path / "logs"), "failOnDataLoss": "false"})
    assert list(relaxed.read(part)) == []
    assert isinstance(part, ByteRange)


def test_stream_restarts_where_it_stopped(spark, tmp_path, log):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        lines = drop_reread_lines(tail_stream(spark, str(tmp_path / "logs"), rangeBytes="7"))
        query = (lines.writeStream.format("parquet").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start(out))
        query.awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    write(log, b"alpha\nbeta\n")
    assert run() == ["alpha", "beta"]
    write(log, b"gamma\nhalf")
    assert run() == ["alpha", "beta", "gamma"]
    write(log, b" done\n")
    assert run() == ["alpha", "beta", "gamma", "half done"]
    assert run() == ["alpha", "beta", "gamma", "half done"]


def test_ingest_keeps_lines_and_catalog_in_step(spark, tmp_path, log):
    paths = [str(tmp_path / name) for name in ("lines", "files", "runs")]

    def run():
        start_ingest(spark, str(tmp_path / "logs"), *paths, str(tmp_path / "cp"), now=True).awaitTermination()

    write(log, b"2024-01-01T00:00:00Z ERROR x\n2024-01-01T00:00:01Z info y\n")
    write(str(tmp_path / "logs" / "ns2_p_u" / "c" / "0.log"), b"warned\n")
    run()
    lines, files, runs = (spark.read.parquet(p) for p in paths)
    assert files.count() == 2 and runs.count() == 1
    row = files.where("ns = 'ns1'").first()
    assert (row.line_count, row.error_count, row.info_count, row.size_bytes) == (2, 1, 1, 57)
    assert {(r.ns, r.line_no, r.start_byte) for r in lines.collect()} == {("ns1", 1, 0), ("ns1", 2, 29), ("ns2", 1, 0)}
    write(log, b"2024-01-01T00:00:02Z debug z\n")
    run()
    lines, files, runs = (spark.read.parquet(p) for p in paths)
    newest = runs.orderBy("run", ascending=False).first()
    assert runs.count() == 2 and newest.file_count == 1 and newest.total_bytes == 29
    assert lines.count() == 4 and files.where(f"run = '{newest.run}'").first().debug_count == 1


def test_qa_scenario_collect_archive_and_retain(spark, tmp_path, log):
    """Numbered lines: the second run holds new lines only; old runs go with everything they own."""
    store, logs = Store(str(tmp_path / "store")), str(tmp_path / "logs")

    def cycle():
        collect(spark, logs, store)
        return archive_new_runs(spark, store)

    write(log, "".join(f"QA_{i}\n" for i in range(1, 65)).encode())
    [first] = cycle()
    write(log, "".join(f"QA_{i}\n" for i in range(65, 99)).encode())
    [second] = cycle()
    assert cycle() == []
    counts = {r.run: r.matches for r in pattern_count_by_run(tables.log_lines(spark, store.lines), "QA_").collect()}
    assert counts == {first: 64, second: 34}
    runs, archives = tables.runs(spark, store.runs), tables.archives(spark, store.archives)
    stats = catalog.dashboard_stats(runs, archives).first()
    assert (stats.runs, stats.files, stats.zips, stats.last_run) == (2, 2, 2, second)

    today = datetime.now()
    assert clean_up(spark, store, today, capacity_bytes=10**9) == []
    assert clean_up(spark, store, today, capacity_bytes=10) == [first]
    assert [r.run for r in tables.runs(spark, store.runs).collect()] == [second]
    assert tables.log_lines(spark, store.lines).count() == 34
    assert tables.log_files(spark, store.files).count() == 1
    assert tables.archives(spark, store.archives).count() == 1
    assert not os.path.exists(f"{store.archive_data}/data/run={first}")
    # The newest run stays, however old it is and however full the store.
    assert clean_up(spark, store, today + timedelta(days=31), capacity_bytes=10) == []
    assert tables.runs(spark, store.runs).count() == 1
    with pytest.raises(ValueError):
        sinks.drop_runs(spark, ["../x"], store.runs)


def test_tables_never_written_are_empty(spark, tmp_path):
    for read in (tables.log_lines, tables.log_files, tables.runs, tables.archives):
        assert read(spark, str(tmp_path / "none")).count() == 0


def test_archives_are_discovered_without_reading_them(spark, tmp_path):
    for run in ("2024-01-01_00-00-00", "2024-01-02_00-00-00"):
        write(str(tmp_path / "zips" / f"archive_{run}.tar.gz"), b"12345")
    got = tables.discover_archives(spark, str(tmp_path / "zips")).collect()
    assert [(r.run, r.size_bytes) for r in got] == [("2024-01-02_00-00-00", 5), ("2024-01-01_00-00-00", 5)]


def test_an_unreadable_compressed_file_waits(tmp_path, log):
    write(log, b"x\n")
    write(log + ".1.gz", b"not gzip")
    steps = Steps(tmp_path / "logs")
    assert [x[2] for x in steps.next()] == ["x"]
    with gzip.open(log + ".1.gz", "wb") as z:
        z.write(b"readable\n")
    assert [x[2] for x in steps.next()] == ["readable"]


def test_a_missing_root_has_no_lines(tmp_path):
    assert Steps(tmp_path / "nowhere").next() == []


def test_a_large_backlog_is_cut_into_ranges_of_one_size(tmp_path, log):
    lines = [f"line {i}" for i in range(500)]
    write(log, ("\n".join(lines) + "\n").encode())
    reader = LogTailReader({"path": str(tmp_path / "logs"), "rangeBytes": "8"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) == -(-os.path.getsize(log) // 8)
    assert [r["line"] for p in parts for b in reader.read(p) for r in b.to_pylist()] == lines


BANNER = b"=" * 64 + b" the same banner of every file\n"


@pytest.mark.parametrize("extra", [0, 5000])
@pytest.mark.parametrize("squeezed", [False, True])
def test_files_that_begin_alike_are_told_apart(tmp_path, log, extra, squeezed):
    """Rotated, and the new file has outgrown the old position when it is listed."""
    old, new = b"old a\n" * 3 + b"o" * extra + b"\n", b"new a\n" * 40 + b"n" * extra + b"\n"
    write(log, BANNER + old)
    steps = Steps(tmp_path / "logs")
    first = steps.next()
    write(log, b"old late\n")
    os.rename(log, log + ".1")
    if squeezed:
        squeeze(log + ".1")
        os.remove(log + ".1")
    write(log, BANNER + new)
    second = steps.next()
    assert [x[2] for x in second if x[0].startswith("0.log.1")] == ["old late"]
    assert [x[2] for x in second if x[0] == "0.log"] == (BANNER + new).decode().splitlines()
    assert len(first) == len((BANNER + old).splitlines()) and steps.next() == []


def test_a_copied_and_truncated_file_is_read_on_under_its_new_name(tmp_path, log):
    write(log, BANNER + b"a\n")
    steps = Steps(tmp_path / "logs")
    steps.next()
    write(log, b"late\n")
    with open(log, "rb") as f:
        write(log + ".1", f.read())
    write(log, BANNER + b"fresh\n" * 30, "wb")
    got = steps.next()
    assert [x[2] for x in got if x[0] == "0.log.1"] == ["late"]
    assert [x[2] for x in got if x[0] == "0.log"][1:] == ["fresh"] * 30


def test_the_fingerprint_of_a_file_does_not_change_as_it_grows(tmp_path, log):
    reader, seen = LogTailReader({"path": str(tmp_path / "logs")}), set()
    at = reader.initialOffset()
    for _ in range(3):
        write(log, b"x\n")
        end = reader.latestOffset()
        seen |= {p.fingerprint for p in reader.partitions(at, end)}
        at = end
    write(log + "x.log", b"x\n")
    seen |= {p.fingerprint for p in reader.partitions(at, reader.latestOffset())}
    assert len(seen) == 2


def test_run_names_are_never_used_twice(tmp_path, log, monkeypatch):
    """Two readers in one second, and a clock that is set back between them."""
    from tidelog.sources import tail

    at, names = LogTailReader({"path": str(tmp_path / "logs")}).initialOffset(), []
    for now in (1_000, 1_000, 400, 401, 2_000):
        monkeypatch.setattr(tail.time, "time", lambda: now)
        reader = LogTailReader({"path": str(tmp_path / "logs")})
        for _ in range(2):
            write(log, b"x\n")
            end = reader.latestOffset()
            names += {p.collected_at for p in reader.partitions(at, end)}
            at = end
    assert len(names) == len(set(names)) == 10


def test_runs_are_named_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("SELECT timestamp_seconds(s) AS ts FROM VALUES (1730611800L), (1730615400L) AS t(s)")
        names = [r[0] for r in rows.select(pipelines.utc_run_name(rows.ts)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert names == ["2024-11-03_05-30-00", "2024-11-03_06-30-00"]


def test_tail_and_batch_agree_on_line_ends(spark, tmp_path, log):
    write(log, b"one\rtwo\r\nthree\r\r\n\n\rfour \xc3\xa9\n")
    got = [x[2] for x in Steps(tmp_path / "logs").next()]
    batch = [r.line for r in read_node_logs(spark, str(tmp_path / "logs")).orderBy("line_no").collect()]
    assert got == batch == ["one", "two", "three", "", "", "", "four é"]
    write(log, b"bad \xff\n")
