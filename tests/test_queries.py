"""Every registered query with SQL, next to DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# the iterative queries are compared at sf0.01 by tests/oracle_check.py; they are too slow to run twice
QUICK = [q for q, f in entry.catalog.QUERIES.items() if q in entry.catalog.ORACLES and f.__module__.rsplit(".", 1)[-1] not in ("walks", "inference")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())
