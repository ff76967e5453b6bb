"""State of the stream de-duplication: byte intervals per file instead of lines."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.sources.tail import SCHEMA
from tidelog.streaming.intervals import covered, drop_read_ranges, united
from tidelog.streaming.pipelines import run_trigger

AT = datetime(2024, 1, 1)


def fetch(file, first, last, hours=0, width=10):
    """Lines first..last-1 of a file, each of ``width`` bytes, as a batch of the tail reads them."""
    at = AT + timedelta(hours=hours)
    return [("ns", "pod", "uid", "app", f"/logs/{file}", file, first * width, i * width, width - 1, f"{file} line {i}"[:width + 20], at)
            for i in range(first, last)]


class Stream:
    """Batches written one by one to a folder that a stream reads; each ``run`` is a restart from the checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.at, self.options, self.n = spark, tmp_path, options, 0
        spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))

    def run(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, SCHEMA).repartition(3).coalesce(1).write.mode("append").parquet(str(self.at / "in"))
            source = self.spark.readStream.schema(SCHEMA).parquet(str(self.at / "in"))
            query = (drop_read_ranges(source, "9 hours", **self.options).writeStream.format("parquet")
                     .option("checkpointLocation", str(self.at / "cp")).trigger(**run_trigger(now=True)).start(str(self.at / "out")))
            query.awaitTermination()
            self.n = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else self.n
        return sorted((r.file_fp, r.start_byte) for r in self.spark.read.parquet(str(self.at / "out")).collect())


def lines(file, first, last, width=10):
    return [(file, i * width) for i in range(first, last)]


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield lambda **options: Stream(spark, tmp_path, **options)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_ranges_read_again_partly_and_after_restarts(stream):
    s = stream()
    got = s.run(fetch("a", 0, 50) + fetch("a", 20, 40) + fetch("b", 0, 5),  # twice within a batch
                fetch("a", 0, 50, 1),  # a range read again
                fetch("a", 30, 80, 2) + fetch("b", 10, 20, 2),  # a partial overlap, a gap
                fetch("b", 3, 12, 3), fetch("a", 0, 80, 4) + fetch("b", 0, 20, 4))
    assert got == lines("a", 0, 80) + lines("b", 0, 20)


def test_state_rows_are_files_and_segments(stream):
    s = stream(segment_bytes=1000)
    got = s.run(fetch("a", 0, 350) + fetch("b", 0, 40), fetch("a", 350, 500, 1) + fetch("c", 0, 7, 1), fetch("a", 90, 110, 1))
    assert got == lines("a", 0, 500) + lines("b", 0, 40) + lines("c", 0, 7)
    values, timers = 5 + 1 + 1, 5 + 1 + 1  # five segments of a; a value and a timer for each
    assert values <= s.n <= values + 2 * timers


def test_state_of_vanished_files_expires(stream):
    s = stream()
    s.run(fetch("gone", 0, 10) + fetch("here", 0, 10))
    before = s.n
    s.run(fetch("here", 10, 12, 8), fetch("here", 12, 14, 16), fetch("here", 14, 15, 17))
    assert 0 < s.n < before
    got = s.run(fetch("here", 0, 16, 18) + fetch("gone", 0, 3, 18))  # the file came back: its bytes are new
    assert got == sorted(lines("gone", 0, 10) + lines("gone", 0, 3) + lines("here", 0, 16))


@pytest.mark.parametrize("seed", range(20))
def test_united_intervals(seed):
    rng = random.Random(seed)
    pairs = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(1, 25)))]
    starts, ends = united(*map(np.array, zip(*pairs)))
    inside = {x for a, b in pairs for x in range(a, b)}
    assert {x for a, b in zip(starts, ends) for x in range(a, b)} == inside
    assert all(starts[1:] > ends[:-1])
    low = np.array([rng.randint(0, 60) for _ in range(50)])
    high = low + np.array([rng.randint(1, 5) for _ in range(50)])
    assert covered(starts, ends, low, high).tolist() == [set(range(a, b)) <= inside for a, b in zip(low, high)]
