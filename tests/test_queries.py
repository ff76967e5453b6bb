"""Every registered query against its DuckDB twin, over whole tables."""

import pytest

import __spark_entry__ as entry
from compare import duck, duck_rows, spark_rows
from tidelog.plans import oracle
from tidelog.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracle.statements())
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(entry.queries()[name](spark, SF))
    expected_names, expected = duck_rows(con, entry.oracle_sql()[name])
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows or name == "search_no_filter"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
