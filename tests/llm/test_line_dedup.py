import random
from collections import defaultdict

import numpy as np
import pytest
from compare import duck, duck_rows, spark_rows
from tidelog.llm import line_dedup
from tidelog.llm.cuckoo import CuckooFilter
from tidelog.llm.line_dedup import LineState
from tidelog.llm.oracle import SQL
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"
STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def plain(docs, min_chars=40, min_docs=5):
    """[(doc_id, text left)] of (doc_id, text) pairs."""
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    common = {k: max(ds) for k, ds in holders.items() if len(k) >= min_chars and len(ds) >= min_docs}
    return sorted((d, "\n".join(x for x in (t or "").split("\n") if common.get(key(x), d) == d)) for d, t in docs)


def made(n=60, seed=1):
    rng = random.Random(seed)
    lines = [f"  Line {i} " + "é" * rng.randint(20, 60) for i in range(25)] + ["short", ""]
    return [(d, "\n".join(rng.choice(lines).swapcase() if rng.random() < 0.2 else rng.choice(lines)
                          for _ in range(rng.randint(0, 8)))) for d in range(n)]


def left(frame):
    return sorted((r.doc_id, r.text or "") for r in frame.collect())


def test_against_duckdb(spark):
    names, rows = spark_rows(QUERIES["op6_line_dedup"](spark, SF))
    expected_names, expected = duck_rows(duck(SF), SQL["op6_line_dedup"])
    assert names == expected_names and rows == expected


def test_against_plain_version(spark):
    docs = made()
    out = line_dedup.drop_common_lines(spark.createDataFrame(docs, SCHEMA))
    assert left(out) == plain(docs) and plain(docs) != sorted(docs)


def test_inserting_and_deleting_is_reversible(spark, tmp_path):
    docs = made()
    frame = spark.createDataFrame(docs, SCHEMA)
    first, second = frame.where("doc_id < 30"), frame.where("doc_id >= 30")
    state = LineState.create(first, str(tmp_path / "a"))
    both = state.add(second)
    assert left(both.apply(frame)) == plain(docs)
    back = both.delete(second.select("doc_id"))
    assert left(back.apply(first)) == plain([d for d in docs if d[0] < 30])
    keys = lambda s: sorted((r.k1, r.k2, r.n_docs, r.last_doc) for r in s.common().collect())
    assert keys(back) == keys(state) != keys(both)
    held = {r.shard: CuckooFilter.load(r.table) for r in back.filters().collect()}
    every = np.array([r.k1 for r in both.common().collect()], np.int64)
    gone = np.array([k for k in every if k not in {x[0] for x in keys(back)}])
    there = [held[k % line_dedup.SHARDS].has(np.array([k]).view(np.uint64))[0] for k in (x[0] for x in keys(back))]
    assert all(there) and len(gone)
    assert not any(held[k % line_dedup.SHARDS].has(np.array([k]).view(np.uint64))[0] for k in gone if k % line_dedup.SHARDS in held)


def test_odd_rows(spark):
    line = "a line of the licence that everyone has to carry along"
    rows = [(d, f"{line}\nmine {d}", d) for d in range(6)] + [(9, None, 0), (10, "", 0), (None, line, 0), (5, line, 0), (5, line, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    out = line_dedup.drop_common_lines(frame)
    assert out.columns == [*frame.columns, "lines_before", "lines_dropped"]
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert got == sorted([*((str(d), f"mine {d}") for d in range(5)), ("5", f"{line}\nmine 5"), ("5", line), ("5", line),
                          ("9", "None"), ("10", ""), ("None", "")])
    assert line_dedup.line_report(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 2**64, n, dtype=np.uint64)
    held = CuckooFilter.load(CuckooFilter.of(h).dump())
    assert held.has(h).all()
    assert held.has(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.001
    assert all(held.remove(x) for x in h)
    assert not held.table.any()
