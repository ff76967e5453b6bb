"""Archives are opened again: the lines before, only the blocks that are wanted, damage found."""

import glob
import gzip
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tidelog.functions.text import line_bytes, sort_key
from tidelog.schemas import LOG_LINES
from tidelog.sources import archives as ar
from tidelog.sources.sinks import drop_runs

RUNS = ["2024-01-01_00-00-00", "2024-01-02_00-00-00"]


def lines_of(spark, files=5, lines=400):
    rows = spark.range(len(RUNS) * files * lines).select(
        F.get(F.array(*map(F.lit, RUNS)), (F.col("id") % 2).cast("int")).alias("run"), (F.floor(F.col("id") / 2) % files).alias("f"),
        (F.floor(F.col("id") / (2 * files)) + 1).alias("line_no"))
    text = F.concat(F.lit("2024-01-01T00:00:00Z line "), F.col("line_no").cast("string"), F.lit(" é日本 "), F.repeat(F.lit("x"), (F.col("line_no") % 50).cast("int")))
    named = rows.select("run", F.concat(F.lit("ns"), F.col("f") % 2).alias("ns"), F.concat(F.lit("pod"), "f").alias("pod"), F.lit("u").alias("uid"),
                        F.lit("app").alias("container"), F.concat(F.lit("file"), "f", F.lit(".log")).alias("filename"), "line_no",
                        F.when(F.col("line_no") % 7 == 0, F.lit("")).otherwise(text).alias("line"))
    crlf = F.when(F.col("line_no") % 5 == 0, 1).otherwise(0)
    sized = named.withColumn("n_bytes", line_bytes(F.col("line")) + crlf)
    return sized.selectExpr("*", "coalesce(sum(n_bytes + 1) over (partition by run, filename order by line_no rows between unbounded "
                                 "preceding and 1 preceding), 0) as start_byte").withColumn("ts_key", sort_key(F.col("line"))).withColumn(
        "ts", F.try_to_timestamp("ts_key")).select(*LOG_LINES.fieldNames())


def rows(df):
    return sorted(tuple(r) for r in df.drop("ts").collect())


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    lines = lines_of(spark)
    lines.write.partitionBy("run").parquet(str(tmp_path_factory.mktemp("lines") / "t"))
    path = str(tmp_path_factory.mktemp("archives"))
    made = ar.write_archives(lines, RUNS, path, block_bytes=2_000)
    return lines, path, made


def test_read_back_after_the_run_is_dropped(spark, archived, tmp_path):
    lines, _, _ = archived
    kept, path = str(tmp_path / "lines"), str(tmp_path / "archive")
    lines.write.partitionBy("run").parquet(kept)
    before = rows(lines.where(f"run = '{RUNS[0]}' and filename = 'file3.log'"))
    ar.write_archives(spark.read.schema(LOG_LINES).parquet(kept), [RUNS[0]], path)
    drop_runs(spark, [RUNS[0]], kept)
    assert not os.path.exists(f"{kept}/run={RUNS[0]}")
    assert rows(ar.read_archived(spark, path, [RUNS[0]], ["file3.log"])) == before and len(before) == 400


def test_everything_comes_back(spark, archived):
    lines, path, made = archived
    assert rows(ar.read_archived(spark, path)) == rows(lines)
    sizes = {r.run: r.size_bytes for r in made.collect()}
    for run in RUNS:
        objects = glob.glob(f"{path}/data/run={run}/*.gz")
        assert sizes[run] == sum(map(os.path.getsize, objects))
        text = b"".join(gzip.open(o).read() for o in objects)  # any tool unpacks an object
        assert text.count(b"\n") == 2_000


def test_only_wanted_blocks_are_fetched(spark, archived):
    lines, path, _ = archived
    index = ar.archive_index(spark, path).collect()
    wanted = [b for b in index if b.filename == "file1.log" and b.run == RUNS[1]]
    assert len(wanted) > 3 and len(index) > 5 * len(wanted)
    broken = str(path) + "-broken"
    import shutil

    shutil.copytree(path, broken)
    ranges = {}
    for b in index:
        if b not in wanted:
            ranges.setdefault(b.object, []).append((b.offset, b.length))
    for name, spans in ranges.items():  # every other block is overwritten
        with open(f"{broken}/data/{name}", "r+b") as f:
            for offset, length in spans:
                f.seek(offset)
                f.write(b"\0" * length)
    got = ar.read_archived(spark, broken, [RUNS[1]], ["file1.log"])
    assert rows(got) == rows(lines.where(f"run = '{RUNS[1]}' and filename = 'file1.log'"))
    with pytest.raises(PythonException, match="is damaged"):
        ar.read_archived(spark, broken, [RUNS[1]], ["file2.log"]).collect()


def test_archives_are_replaced_and_swept(spark, tmp_path):
    lines, path = lines_of(spark, files=2, lines=30), str(tmp_path / "a")
    assert ar.archive_rows(spark, path).collect() == []
    ar.write_archives(lines, RUNS, path)
    ar.write_archives(lines.where("filename = 'file1.log'"), [RUNS[0]], path)
    assert rows(ar.read_archived(spark, path)) == rows(lines.where(f"run = '{RUNS[1]}' or filename = 'file1.log'"))
    with open(f"{path}/data/run={RUNS[0]}/left-by-a-lost-task.log.gz", "wb") as f:
        f.write(b"x")
    assert ar.sweep_archives(spark, path) == 1 and ar.sweep_archives(spark, path) == 0
    assert ar.write_archives(lines.limit(0), [RUNS[0]], path).collect() == []
    assert {r.run for r in ar.archive_rows(spark, path).collect()} == {RUNS[1]}


def test_a_hot_file_is_many_blocks(spark, tmp_path):
    lines, path = lines_of(spark, files=1, lines=20_000), str(tmp_path / "hot")
    ar.write_archives(lines, RUNS, path, block_bytes=50_000)
    index = ar.archive_index(spark, path).where(f"run = '{RUNS[0]}'")
    assert index.count() > 20
    some = ar.open_blocks(index.where("first_line <= 5000 and first_line + n_lines > 5000"), path)
    assert some.where("line_no = 5000").count() == 1 and some.count() < 3_000
