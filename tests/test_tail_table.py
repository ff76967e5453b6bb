"""The tail whose state is a table: bounded versions, renames while bytes wait, stops, many files."""

import gzip
import os
import random

import pytest

from tidelog.sources import tail_table
from tidelog.sources.run_store import RunStore
from tidelog.sources.tail_table import TailTable, collect_into
from tidelog.streaming.pipelines import as_log_lines


class Case:
    def __init__(self, spark, tmp_path, **options):
        self.logs = tmp_path / "logs"
        self.folder = self.logs / "ns_pod_uid" / "app"
        self.folder.mkdir(parents=True)
        self.store = RunStore(spark, str(tmp_path / "store"))
        self.options = options
        self.table = lambda: TailTable(spark, str(self.logs), str(tmp_path / "state"), **self.options)  # as after a restart

    def write(self, name, lines, mode="a"):
        with open(self.folder / name, mode) as f:
            f.writelines(f"{x}\n" for x in lines)

    def version(self):
        """Read one version; its lines in the order of their files."""
        table = self.table()
        planned = table.plan()
        if planned is None:
            return []
        rows = table.lines(planned[0]).collect()
        table.commit(planned[0])
        return [r.line for r in sorted(rows, key=lambda r: (r.path, r.start_byte))]

    def rest(self):
        out = []
        for _ in range(200):
            if self.table().plan() is None:
                return out
            out += self.version()
        raise AssertionError("it does not end")

    def stored(self):
        return sorted(r.line for r in self.store.lines().select("line").collect())


def test_growth_unfinished_lines_rotation_and_deletion(spark, tmp_path):
    case = Case(spark, tmp_path)
    assert case.version() == []
    case.write("0.log", ["one", "two"])
    with open(case.folder / "0.log", "a") as f:
        f.write("unfin")
    assert case.version() == ["one", "two"] and case.version() == []
    with open(case.folder / "0.log", "a") as f:
        f.write("ished\n")
    os.rename(case.folder / "0.log", case.folder / "0.log.1")
    case.write("0.log", ["new"])
    assert case.version() == ["new", "unfinished"] and case.version() == []
    os.remove(case.folder / "0.log.1")
    assert case.version() == []
    os.remove(case.folder / "0.log")
    os.rmdir(case.folder)
    os.rmdir(case.folder.parent)
    assert case.version() == [] and case.table().state().isEmpty()


def test_a_backlog_is_read_in_bounded_versions(spark, tmp_path):
    case = Case(spark, tmp_path, max_bytes=100, range_bytes=64)
    case.write("0.log", [f"line {i:04d}" for i in range(60)])  # 600 bytes
    other = case.logs / "ns_other_uid" / "app"
    other.mkdir(parents=True)
    (other / "0.log").write_text("".join(f"other {i:03d}\n" for i in range(30)))
    sizes, seen = [], []
    while (planned := case.table().plan()) is not None:
        assert case.table().plan() == planned  # a plan that is there is taken up
        plan = spark.read.schema(tail_table.PLAN).parquet(f"{case.table()._path(planned[0])}/plan")
        sizes.append(sum(r.bytes for r in plan.collect()))
        seen += case.version()
    assert sorted(seen) == sorted([f"line {i:04d}" for i in range(60)] + [f"other {i:03d}" for i in range(30)])
    assert max(sizes) <= 100 and len(sizes) >= 9


def test_a_file_that_is_renamed_while_its_bytes_wait(spark, tmp_path):
    case = Case(spark, tmp_path, max_bytes=50)
    first = [f"a{i:03d}" for i in range(40)]  # 200 bytes
    case.write("0.log", first)
    got = case.version()
    assert 0 < len(got) < 40
    os.rename(case.folder / "0.log", case.folder / "0.log.1")
    case.write("0.log", second := [f"b{i:03d}" for i in range(20)])
    got += case.version()
    os.rename(case.folder / "0.log.1", case.folder / "0.log.2")
    os.rename(case.folder / "0.log", case.folder / "0.log.1")
    case.write("0.log", third := [f"c{i:03d}" for i in range(5)])
    got += case.rest()
    assert sorted(got) == sorted(first + second + third)


def test_a_file_that_is_copied_and_truncated_or_compressed_while_its_bytes_wait(spark, tmp_path):
    case = Case(spark, tmp_path, max_bytes=30)
    case.write("0.log", first := [f"a{i:03d}" for i in range(20)])
    got = case.version()
    data = (case.folder / "0.log").read_bytes()
    (case.folder / "0.log.1").write_bytes(data)
    case.write("0.log", [], "w")
    got += case.version()  # the truncated file has no bytes, the copy waits
    case.write("0.log", second := [f"b{i:03d}" for i in range(9)])
    got += case.version()
    (case.folder / "0.log.1.gz").write_bytes(gzip.compress(data))
    os.remove(case.folder / "0.log.1")
    got += case.rest()
    assert sorted(got) == sorted(first + second)


@pytest.mark.parametrize("full", [2, 16])
def test_random_histories_lose_and_repeat_nothing(spark, tmp_path, full, monkeypatch):
    monkeypatch.setattr(tail_table, "FULL_EVERY", full)
    rng, case, n, all_lines, got = random.Random(full), Case(spark, tmp_path, max_bytes=120), 0, [], []
    for turn in range(6):
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.4 and (case.folder / "0.log").exists():
                for k in range(9, 0, -1):
                    if (case.folder / f"0.log.{k}").exists():
                        os.rename(case.folder / f"0.log.{k}", case.folder / f"0.log.{k + 1}")
                os.rename(case.folder / "0.log", case.folder / "0.log.1")
            some = [f"{rng.choice('xyz')} line {n + i}" for i in range(rng.randint(0, 25))]
            n += len(some)
            all_lines += some
            case.write("0.log", some)
        got += case.version()
    got += case.rest()
    assert sorted(got) == sorted(all_lines)


@pytest.mark.parametrize("step", ["listing", "plan", "planned", "stored", "committed"])
def test_stopped_after_any_step(spark, tmp_path, step, monkeypatch):
    case = Case(spark, tmp_path, max_bytes=120)
    case.write("0.log", lines := [f"line {i:02d}" for i in range(20)])
    writer = type(spark.range(1).write)
    parquet, mark, put = writer.parquet, tail_table.mark_folder, RunStore.put

    def write(self, path, *args, **kwargs):
        parquet(self, path, *args, **kwargs)
        if path.rpartition("/")[2] == step:
            raise KeyboardInterrupt

    def marked(session, path):
        mark(session, path)
        if path.rpartition("/")[2].lower() == step:
            raise KeyboardInterrupt

    def stored(self, rows):
        names = put(self, rows)
        if step == "stored":
            raise KeyboardInterrupt
        return names

    with monkeypatch.context() as m:
        m.setattr(writer, "parquet", write)
        m.setattr(tail_table, "mark_folder", marked)
        m.setattr(RunStore, "put", stored)
        with pytest.raises(KeyboardInterrupt):
            collect_into(case.store, case.table())
    case.write("0.log", more := ["later"])
    collect_into(case.store, case.table())
    collect_into(case.store, case.table())
    assert case.stored() == sorted(lines + more)
    assert collect_into(case.store, case.table()) == []


def test_many_small_files_and_a_backlog(spark, tmp_path):
    """100,000 files; a version's tasks are far fewer than its files, and an unchanged file is not opened again."""
    root = tmp_path / "logs"
    for p in range(100):
        for c in range(4):
            folder = root / f"ns{p % 7}_pod{p}_uid{p}" / f"c{c}"
            folder.mkdir(parents=True)
            for f in range(249):
                (folder / f"0.log.{f:03d}").write_text(f"{p}.{c}.{f}\n")
            (folder / "0.log").write_text(f"{p}.{c}.active\n")
    table = TailTable(spark, str(root), str(tmp_path / "state"), max_bytes=700_000)
    total = versions = 0
    while (planned := table.plan()) is not None:
        lines = table.lines(planned[0])
        assert lines.rdd.getNumPartitions() <= 64
        total += lines.select("line").distinct().count()
        table.commit(planned[0])
        versions += 1
    assert total == 100_000 and versions >= 2
    (root / "ns0_pod0_uid0" / "c0" / "0.log").open("a").write("more\n")
    version, _ = table.plan()
    assert spark.read.parquet(f"{table._path(version)}/listing").count() == 1  # the one folder that changed
    assert [r.line for r in table.lines(version).collect()] == ["more"]


def test_runs_are_numbered_and_named(spark, tmp_path):
    case = Case(spark, tmp_path, max_bytes=40)
    case.write("0.log", [f"line {i:02d}" for i in range(12)])
    names = collect_into(case.store, case.table())
    assert len(names) == len(set(names)) >= 3 and names == sorted(names)
    rows = case.store.lines().collect()
    assert sorted(r.line for r in rows) == [f"line {i:02d}" for i in range(12)]
    assert as_log_lines(case.table().lines(1)).columns == case.store.lines().columns
