"""Every query with SQL gives the rows DuckDB gives."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, ORACLE[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(entry.queries())
