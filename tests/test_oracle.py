"""Every registered query against its DuckDB twin."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0


def test_sql_only_for_registered_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
