import glob
import gzip
import hashlib
import os

import pytest
from compare import duck, duck_rows, spark_rows
from pyspark.sql import functions as F
from tidelog.llm import warc
from tidelog.llm.oracle import SQL
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, html string"
LONG = "<p>" + "same words " * 20


def files(folder):
    return {os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{folder}/*.warc.gz")}


def test_report_against_duckdb(spark):
    names, rows = spark_rows(QUERIES["op1_warc"](spark, SF))
    expected_names, expected = duck_rows(duck(SF), SQL["op1_warc"])
    assert names == expected_names and rows == expected


def test_copies_are_revisits(spark, tmp_path):
    rows = [(5, "http://a/5", LONG), (2, "http://a/2", LONG), (9, None, LONG), (1, "u", "short"), (3, "u", "short"), (None, "u", LONG)]
    folder = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame(rows, SCHEMA), folder)
    got = {r.page_id: r for r in warc.read_pages(spark, folder).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), None: ("revisit", 2), 1: ("response", None), 3: ("response", None)}
    assert got[2].payload == LONG.encode() and got[5].payload is None and got[5].payload_bytes == len(LONG)
    assert got[5].payload_digest == hashlib.sha256(LONG.encode()).hexdigest()


def test_files_depend_on_the_records_alone(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for name, frame in (("a", pages), ("b", pages.repartition(7).orderBy(F.rand(3)))):
        warc.write_pages(frame, f"file://{tmp_path}/{name}", file_bytes=1 << 15, shard_bytes=1 << 17)
    a, b = files(tmp_path / "a"), files(tmp_path / "b")
    assert a == b and len(a) > 6 and any(name.endswith("-0001.warc.gz") for name in a)
    manifest = {r.name: r for r in warc.read_manifest(spark, f"file://{tmp_path}/a").collect()}
    assert set(manifest) == set(a) and not os.listdir(tmp_path / "a" / "tmp")
    for name, data in a.items():
        assert (manifest[name].size, manifest[name].sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_records_are_in_key_order_across_files(spark, tmp_path):
    warc.write_pages(spark.read.parquet(f"{SF}/pages.parquet"), f"file://{tmp_path}/a", 1 << 15, 1 << 17)
    keys = []
    for _, data in sorted(files(tmp_path / "a").items()):
        import io
        keys += [int(h["x-row-key"]) for h, _ in warc.records(gzip.GzipFile(fileobj=io.BytesIO(data))) if h["warc-type"] != "warcinfo"]
    assert keys == sorted(keys) and len(keys) == 250


def test_leftovers_of_a_lost_task_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame([(1, "u", "x")], SCHEMA), folder)
    (tmp_path / "w" / "part-999999-0000.warc.gz").write_bytes(b"unfinished")
    assert [r.page_id for r in warc.read_pages(spark, folder).collect()] == [1]


def test_damage_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame([(1, "u", "payload")], SCHEMA), folder)
    (path,) = glob.glob(f"{tmp_path}/w/*.warc.gz")
    data = gzip.decompress(open(path, "rb").read()).replace(b"payload", b"pAyload")
    open(path, "wb").write(gzip.compress(data))
    with pytest.raises(Exception, match="digest"):
        warc.read_pages(spark, folder).collect()


def test_cuts_follow_bytes(spark):
    sizes = spark.createDataFrame([(i, 100) for i in range(1000)] + [(10**15, 5), (-(1 << 63), 7)], "key bigint, size bigint")
    cuts = warc.byte_cuts(sizes, 10_000)
    assert cuts == sorted(cuts) and cuts[-1] == 10**15
    held = {r[0]: r[1] for r in sizes.groupBy(warc.cell_of(F.col("key"), cuts).alias("c")).agg(F.sum("size")).collect()}
    assert max(held.values()) <= 10_000 and len(held) < 25


def test_odd_rows(spark, tmp_path):
    rows = [(1, "http://x/a b\r\nX: y", None, 1), (None, None, "", 1), (2, "u", "é" * 70, 1), (2, "u", "é" * 70, 1), (3, "u", "z" * 3_000_000, 1)]
    frame = spark.createDataFrame(rows, f"{SCHEMA}, shard int")
    folder = f"file://{tmp_path}/w"
    warc.write_pages(frame, folder)
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes) for r in warc.read_pages(spark, folder).collect())
    assert got == [("1", "response", 0), ("2", "response", 140), ("2", "response", 140), ("3", "response", 3_000_000), ("None", "response", 0)]
    assert {r.url for r in warc.read_pages(spark, folder).collect()} == {"http://x/a%20b%0D%0AX:%20y", None, "u"}
    assert warc.archive_report(spark.createDataFrame([], SCHEMA)).collect() == []
