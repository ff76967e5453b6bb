"""Queries on badly skewed input: one user, one timestamp and one source hold most of the rows."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from compare import duck, duck_rows, spark_rows
from tidelog.operators import ordinals, zones
from tidelog.plans import adapters

QUERIES = ["line_positions", "incremental_lines", "next_offsets", "head_n_per_file", "tail_n_per_file",
           "file_level_counts", "merge_view", "merge_whole_files", "merge_all_files", "overlap_dedup", "split_parts",
           "split_parts_summary", "part_names", "previous_only_lines", "union_phases", "search_top500",
           "level_counts_tumbling", "capacity_cleanup", "selection_join", "extract_ts"]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("skewed")
    n, tied = 4_000, datetime(2024, 1, 2, 12)
    events = {"event_id": [], "ts": [], "user_id": [], "event_type": [], "value": [], "props": []}
    for i in range(n):
        row = (i, tied if rng.random() < 0.4 else datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(28 * 86_400 * 10**6)),
               7 if rng.random() < 0.4 else rng.randrange(40), rng.choice(["error", "click", "purchase", "signup", "view"]),
               rng.random(), '{"k": %d}' % rng.randrange(100))
        for column, value in zip(events.values(), row):
            column.append(value)
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
                        ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.table(events, schema=schema), str(folder / "events.parquet"))
    docs = {"doc_id": list(range(300)), "text": [], "lang": ["en"] * 300, "source": [], "n_chars": []}
    for i in range(300):
        lines = ["é" * rng.randrange(80) for _ in range(rng.choice([1, 3, 500 if i == 9 else 5]))]
        docs["text"].append("\n".join(lines))
        docs["source"].append("hot" if rng.random() < 0.6 else f"src{i % 7}")
        docs["n_chars"].append(len(docs["text"][-1]))
    pq.write_table(pa.table(docs), str(folder / "documents.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_skewed(spark, skewed, name, monkeypatch):
    monkeypatch.setattr(ordinals, "ROWS_PER_CHUNK", 100)
    monkeypatch.setattr(zones, "RANGE_ROWS", 150)
    monkeypatch.setattr(adapters, "DOCS_PER_CHUNK", 10)
    names, rows = spark_rows(entry.queries()[name](spark, skewed))
    expected_names, expected = duck_rows(duck(skewed), entry.oracle_sql()[name])
    assert names == expected_names and rows == expected and rows
