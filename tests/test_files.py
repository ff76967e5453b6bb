"""File readers and writers on small generated folders."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import catalog, export, incremental
from tidelog.operators.merge import export_lines, make_selection, merge_sources, selected_lines
from tidelog.sources import sinks, state, text_tree

RUN = "2024-01-01_00-00-00"


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def python_lines(data):
    """Universal newlines over replacement-decoded text."""
    text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


ENCODINGS = {
    "plain": b"a\nb\n", "no_end": b"a\nb", "crlf": b"a\r\nb\r\n", "cr": b"a\rb\rc\n", "mixed": b"a\r\r\nb\n\r\nc",
    "empty_lines": b"\n\n\nx\n\n", "separators": "a\vb\x0cc\x85d e\n".encode(), "utf8": "é日本\nü\n".encode(),
}


@pytest.mark.parametrize("name", sorted(ENCODINGS))
def test_line_rule_and_positions(spark, tmp_path, name):
    data = ENCODINGS[name]
    put(str(tmp_path / RUN / f"n__p__{name}__{RUN}.log"), data)
    rows = text_tree.read_run(spark, str(tmp_path), RUN).orderBy("line_no").collect()
    assert [r.line for r in rows] == python_lines(data)
    assert [r.line_no for r in rows] == list(range(1, len(rows) + 1))
    for r in rows:
        assert data[r.start_byte:r.start_byte + r.n_bytes] == r.line.encode()
        assert (r.ns, r.pod, r.container, r.run) == ("n", "p", name, RUN)


def test_invalid_utf8_is_replaced_and_an_empty_file_has_no_line(spark, tmp_path):
    put(str(tmp_path / RUN / "n__p__c.log"), b"ok\n\xff\xfebad\nend\n")
    put(str(tmp_path / RUN / "n__p__empty.log"), b"")
    rows = text_tree.read_run(spark, str(tmp_path), RUN).orderBy("line_no").collect()
    assert [(r.line_no, r.start_byte, r.n_bytes) for r in rows] == [(1, 0, 2), (2, 3, 5), (3, 9, 3)]
    assert rows[1].line == "��bad"


def test_a_large_file_in_many_splits_is_numbered_right(spark, tmp_path):
    rng = random.Random(2)
    lines = [f"{i} " + "x" * rng.randrange(60) for i in range(12_000)]
    put(str(tmp_path / RUN / "n__p__c.log"), ("\n".join(lines) + "\n").encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = text_tree.read_run(spark, str(tmp_path), RUN)
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / RUN)).rdd.getNumPartitions() > 5
        rows = {r.line_no: (r.line, r.start_byte) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    at = 0
    for i, line in enumerate(lines):
        assert rows[i + 1] == (line, at)
        at += len(line) + 1


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "pods")
    for ns, pod, uid in [("ns1", "pod-a", "u1"), ("ns2", "pod-b", "u2")]:
        for container in ("app", "side"):
            put(f"{root}/{ns}_{pod}_{uid}/{container}/0.log", f"{ns} {container} active\n".encode())
    put(f"{root}/malformed/app/0.log", b"never\n")
    old = put(f"{root}/ns1_pod-a_u1/app/0.log.20240101", b"rotated one\nrotated two\n")
    os.utime(old, (1_000, 1_000))
    with gzip.open(f"{root}/ns1_pod-a_u1/app/0.log.20240102.gz", "wb") as f:
        f.write(b"zipped\n")
    return root


def test_node_tree(spark, tree):
    rows = text_tree.read_node_logs(spark, tree).collect()
    assert sorted((r.ns, r.pod, r.uid, r.container, r.line) for r in rows) == [
        (ns, pod, uid, c, f"{ns} {c} active")
        for ns, pod, uid in [("ns1", "pod-a", "u1"), ("ns2", "pod-b", "u2")] for c in ("app", "side")]
    assert {r.ns for r in text_tree.read_node_logs(spark, tree, namespaces=["ns2"]).collect()} == {"ns2"}


def test_rotated_files_come_first_and_old_ones_are_pruned(spark, tree):
    both = text_tree.read_rotated_and_active(spark, tree).where("ns = 'ns1' and container = 'app'")
    ordered = both.orderBy("src_rank", "file_name", "line_no").collect()
    assert [r.line for r in ordered] == ["rotated one", "rotated two", "zipped", "ns1 app active"]
    recent = text_tree.read_node_logs(spark, tree, rotated=True, modified_after="2020-01-01T00:00:00")
    assert [r.line for r in recent.collect()] == ["zipped"]


def test_runs_listing_and_usage(spark, tmp_path):
    put(str(tmp_path / "2024-01-01_00-00-00" / "a__b__c__r.log"), b"x\ny\n")
    put(str(tmp_path / "2024-01-02_00-00-00" / "a__b__c__r.log"), b"z\n")
    put(str(tmp_path / ".hidden" / "a__b__c__r.log"), b"no\n")
    lines = text_tree.read_runs(spark, str(tmp_path))
    assert [r.run for r in catalog.list_runs(lines).collect()] == ["2024-01-02_00-00-00", "2024-01-01_00-00-00"]
    files = text_tree.list_files(spark, str(tmp_path), "*.log")
    assert files.agg(F.sum("size_bytes")).first()[0] == 6


def test_inventory(spark, tmp_path):
    put(str(tmp_path / "inv" / "ns1.txt"), b"pod-a  app,side\npod-b\n\npod-c one , two\n")
    rows = text_tree.read_inventory(spark, str(tmp_path / "inv"))
    got = {(r.ns, r.pod, r.container) for r in incremental.explode_inventory(rows).collect()}
    assert got == {("ns1", "pod-a", "app"), ("ns1", "pod-a", "side"), ("ns1", "pod-c", "one")}


def test_offsets_state(spark, tmp_path):
    put(str(tmp_path / "offsets" / "a.json"), b'{"/x/0.log": 12, "/y/0.log": 5000000000}')
    put(str(tmp_path / "offsets" / "b.json"), b"{ not json")
    got = state.read_offsets_json(spark, str(tmp_path / "offsets"))
    assert {tuple(r) for r in got.collect()} == {("/x/0.log", 12), ("/y/0.log", 5_000_000_000)}
    assert state.read_offsets_json(spark, str(tmp_path / "absent")).count() == 0
    state.write_offsets(got, str(tmp_path / "table"))
    assert state.read_offsets(spark, str(tmp_path / "table")).count() == 2


@pytest.fixture
def run_lines(spark, tmp_path):
    rng = random.Random(4)
    for i in range(3):
        text = "\n".join(f"{n} " + "y" * rng.randrange(40) for n in range(200)) + "\n"
        put(str(tmp_path / "in" / RUN / f"n__p{i}__c__{RUN}.log"), text.encode())
    return text_tree.read_run(spark, str(tmp_path / "in"), RUN)


def read_parts(folder):
    """File name to content, parts in order."""
    out = {}
    for directory, _, names in os.walk(folder):
        for name in sorted(n for n in names if n.endswith((".txt", ".gz")) and not n.startswith(".")):
            opener = gzip.open if name.endswith(".gz") else open
            with opener(os.path.join(directory, name), "rb") as f:
                key = os.path.basename(directory).removeprefix("file=")
                out[key] = out.get(key, b"") + f.read()
    return out


@pytest.mark.parametrize("limit", [500, 10**9])
def test_parts_are_bounded_and_add_up_to_the_input(tmp_path, run_lines, limit):
    sinks.write_text(run_lines, str(tmp_path / "out"), limit)
    parts = read_parts(str(tmp_path / "out"))
    for i in range(3):
        stem = f"n__p{i}__c__{RUN}"
        mine = [stem + ".log"] + [f"{stem}.part{k}.log" for k in range(1, len(parts))]
        content = b"".join(parts[m] for m in mine if m in parts)
        with open(str(tmp_path / "in" / RUN / f"{stem}.log"), "rb") as f:
            assert content == f.read()
    assert all(len(p) < limit + 60 for p in parts.values())


def test_selection_and_single_file_export(spark, tmp_path, run_lines):
    name = f"n__p1__c__{RUN}.log"
    chosen = make_selection(spark, [RUN, RUN, RUN], [name, name, "missing.log"])
    sinks.write_selection(run_lines, chosen, str(tmp_path / "sel"))
    with open(str(tmp_path / "in" / RUN / name), "rb") as f:
        content = f.read()
    assert read_parts(str(tmp_path / "sel")) == {name: content}
    sinks.write_file(run_lines, RUN, name, str(tmp_path / "one"))
    assert read_parts(str(tmp_path / "one")) == {name: content}
    with pytest.raises(FileNotFoundError):
        sinks.write_file(run_lines, RUN, "missing.log", str(tmp_path / "none"))


def test_archive(spark, tmp_path, run_lines):
    row = sinks.archive_run(run_lines, RUN, str(tmp_path / "zip")).first()
    held = read_parts(str(tmp_path / "zip"))
    assert len(held) == 3 and row.filename == f"archive_{RUN}.tar.gz"
    sizes = [os.path.getsize(os.path.join(d, n)) for d, _, ns in os.walk(tmp_path / "zip") for n in ns if n.endswith(".gz")]
    assert row.size_bytes == sum(sizes)
    assert sinks.archive_run(run_lines, "2000-01-01_00-00-00", str(tmp_path / "zip")).count() == 0


def test_index_write_replaces_a_run_and_keeps_the_others(spark, tmp_path, run_lines):
    files, runs, table = (str(tmp_path / x) for x in ("files", "runs", "lines"))
    other = run_lines.withColumn("run", F.lit("2024-01-02_00-00-00"))
    sinks.write_log_lines(run_lines.unionByName(other), table)
    stored = spark.read.parquet(table)
    catalog.write_index(catalog.index_files(stored), files, runs)
    again = stored.where((F.col("run") == RUN) & (F.col("pod") != "p2"))
    catalog.write_index(catalog.index_files(again), files, runs)
    got = {r.run: (r.file_count, r.total_bytes) for r in spark.read.parquet(runs).collect()}
    assert got[RUN][0] == 2 and got["2024-01-02_00-00-00"][0] == 3
    assert spark.read.parquet(files).where(F.col("run") == RUN).count() == 2
    plan = stored.where(F.col("run") == RUN)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan


def test_sampled_and_exact_level_counts(spark):
    rows = [("r", "f", "n", "p", "c", i + 1, 5, "error" if i in (0, 199, 200, 4_999, 5_000) else "ok") for i in range(6_000)]
    df = spark.createDataFrame(rows, "run string, filename string, ns string, pod string, container string, "
                                     "line_no bigint, n_bytes bigint, line string")
    assert catalog.index_files(df).first().error_count == 5
    assert catalog.index_files(df, 200).first().error_count == 2
    assert catalog.index_files(df, 5_000).first().error_count == 4
    assert catalog.index_files(df, None).first().error_count == 5
    bare = df.withColumnRenamed("line_no", "at")
    assert catalog.index_files(bare, 200, order=["at"]).first().error_count == 2
    assert catalog.index_files(bare, 5_000, order=["at"]).first().error_count == 4


def test_empty_outputs_do_not_exist(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 3)], "f string, n_bytes bigint")
    assert [r.f for r in export.nonempty_outputs(df, ["f"]).collect()] == ["a", "b"]


def test_batch_collection_resumes_by_offset(spark, tmp_path):
    """Two collections of a node tree: growth, rotation with skipped bytes, a file read from its start."""
    root = str(tmp_path / "pods")
    grown = put(f"{root}/ns1_pod-a_u1/app/0.log", b"one\ntwo\n")
    turned = put(f"{root}/ns2_pod-b_u2/app/0.log", b"old1\nold2\n")
    same = put(f"{root}/ns3_pod-c_u3/app/0.log", b"same\n")

    def files():
        return text_tree.list_node_files(spark, root)

    state.write_offsets(incremental.next_offsets(files(), "path"), str(tmp_path / "offsets"))
    offsets = state.read_offsets(spark, str(tmp_path / "offsets"))
    assert offsets.count() == 3
    put(grown, b"one\ntwo\nthree\n")
    os.rename(turned, turned + ".20240101")
    put(turned + ".20240101", b"old1\nold2\nlate\n")
    put(turned, b"new\n")

    active = incremental.incremental_lines(text_tree.read_node_logs(spark, root), files(), offsets, path="path")
    assert sorted(r.line for r in active.collect()) == ["new", "three"]
    rotated = text_tree.read_node_logs(spark, root, rotated=True)
    listed = text_tree.list_node_files(spark, root, rotated=True).withColumnRenamed("file_name", "name")
    active_offsets = files().join(offsets, "path")
    skips = incremental.rotated_skip_bytes(listed, active_offsets, F.lit("2000-01-01").cast("timestamp"))
    assert [r.line for r in incremental.skip_collected(rotated, skips).collect()] == ["late"]
    os.remove(same)
    gone = incremental.dead_offsets(offsets, files(), "path").collect()
    assert [os.path.basename(os.path.dirname(os.path.dirname(r.path))) for r in gone] == ["ns3_pod-c_u3"]


def test_a_smaller_export_leaves_no_old_parts(spark, tmp_path):
    name, out = f"n__p__c__{RUN}.log", str(tmp_path / "out")
    lines = spark.createDataFrame([(RUN, "n", name, i + 1, 10 * i, 9, f"line {i:04d}") for i in range(5)],
                                  "run string, ns string, filename string, line_no int, start_byte int, n_bytes int, line string")
    other = lines.withColumn("filename", F.lit("other.log"))
    sinks.write_text(lines.unionAll(other), out, 20)
    assert len(read_parts(out)) == 6
    sinks.write_text(lines.limit(1), out, 20)
    parts = read_parts(out)
    assert parts[name] == b"line 0000\n" and len(parts) == 4  # the other file keeps its three


def test_an_archive_written_again_counts_only_its_own_bytes(spark, tmp_path, run_lines):
    first = sinks.archive_run(run_lines, RUN, str(tmp_path / "zip"), 100).first()
    again = sinks.archive_run(run_lines.where("line_no <= 2"), RUN, str(tmp_path / "zip"), 100).first()
    sizes = [os.path.getsize(os.path.join(d, n)) for d, _, ns in os.walk(tmp_path / "zip") for n in ns if n.endswith(".gz")]
    assert again.size_bytes == sum(sizes) < first.size_bytes


def test_a_selection_prunes_runs_and_files(spark, tmp_path, run_lines):
    table = str(tmp_path / "table")
    sinks.write_log_lines(run_lines.unionAll(run_lines.withColumn("run", F.lit("2024-09-09_00-00-00"))), table)
    name = f"n__p1__c__{RUN}.log"
    stored, chosen = spark.read.parquet(table), make_selection(spark, [RUN], [name])
    for frame in (selected_lines(stored, chosen), export_lines(stored, chosen), merge_sources(stored, chosen)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "(run#" in plan and f"= {RUN})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
        assert f"EqualTo(filename,{name})" in plan
