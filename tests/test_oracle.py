"""Every registered query with SQL gives the same columns, types and rows as DuckDB."""

import pytest

import __spark_entry__ as entry_points
from suite.registry import QUERIES, SQL
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    problem = compare(QUERIES[name](spark, SF_DIR), con, SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["property_id", "kind", "rank", "topic", "negative_rate_gap"]
    assert df.limit(1).count() == 1
