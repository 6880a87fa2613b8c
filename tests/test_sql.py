"""Every core query that has SQL against DuckDB; the others must run."""

import pytest

from tests.compare import assert_same, database
from tsugumi import data_queries, search_queries

QUERIES = data_queries.QUERIES | search_queries.QUERIES
SQL = data_queries.SQL | search_queries.SQL


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, small, con, name):
    assert_same(QUERIES[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.collect() is not None


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
