"""Every corpus query over whole small tables; those with SQL next to DuckDB."""

import duckdb
import pytest

from terrane.llm import queries
from tests.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        res = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in res.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, res.fetchall())
