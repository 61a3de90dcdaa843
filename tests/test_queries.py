"""Every registered query runs; those with SQL agree with DuckDB."""

import pytest

import __spark_entry__ as entry
from workload import registry
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}, registry.SQL


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        assert compare(rows, df.dtypes, duck, SQL[name]) is None
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
