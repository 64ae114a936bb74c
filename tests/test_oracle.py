"""Every query with an oracle gives DuckDB's answer on sf0.001 (the driver
checks sf0.01 the same way)."""

import pytest

import __spark_entry__ as E
from oracle_check import canon, duck

from conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, rows) == canon(ocols, cur.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["product_line", "sales"]
    assert df.count() > 0
