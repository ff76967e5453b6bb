"""Physical plans of every registered query: what they must not contain, and what must be pruned."""

import re

import pytest

from tidelog.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython",
             "MapInPandas", "MapInArrow", "FlatMapGroups"]

# Unpartitioned windows are allowed over: a limited report, a merge of bounded tails, one row per
# day (capacity), and a whole merge that was counted to fit one chunk.
GLOBAL_WINDOW = {"runs_page", "search_top500", "merge_view", "merge_whole_files", "merge_all_files",
                 "capacity_cleanup"}

# Global aggregates gather one partial row per task.
ONE_ROW = {"dashboard_stats", "cleanup_counts", "retention_next", "search_count", "merge_summary", "merged_filter_count", "shown_line_count",
           "storage_usage", "phase_counts"}


# Blocks of compressed objects are opened by byte range, which needs a task function.
OPENS_OBJECTS = {"archive_read_back"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(query(spark, SF)) for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(plans, name):
    plan = plans[name]
    assert not [word for word in FORBIDDEN if word in plan] or name in OPENS_OBJECTS
    assert "Exchange SinglePartition" not in plan or (
        name in GLOBAL_WINDOW or name in ONE_ROW)


def columns_read(plan):
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


def test_columns_are_pruned(plans):
    assert columns_read(plans["distinct_namespaces"]) == [{"user_id"}]
    assert columns_read(plans["list_runs"]) == [{"ts"}]
    assert columns_read(plans["file_line_counts"]) == [{"ts", "user_id"}]
    assert columns_read(plans["run_bucket"]) == [{"event_id", "ts"}]


def test_run_predicates_reach_the_scan(plans):
    for name in ("run_files", "search_lines", "search_date_range", "index_run"):
        for pushed in re.findall(r"PushedFilters: \[([^\]]*)\]", plans[name]):
            assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_reports_are_top_k(plans):
    for name in ("search_top500", "runs_page", "retention_next"):
        assert "TakeOrderedAndProject" in plans[name]


def test_aggregates_combine_before_the_shuffle(plans):
    for name in ("file_line_counts", "run_totals", "level_counts_tumbling", "overlap_dedup", "phase_counts"):
        assert "partial_" in plans[name] or plans[name].count("HashAggregate") >= 2
