"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def engine(tables):
    return connect(tables)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, engine, tables, name):
    problem, rows, _, _ = compare(spark, engine, name, QUERIES[name], SQL.get(name), tables)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 61
