"""The driver contract, over the smallest tables, against DuckDB."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from factloom import queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(frame):
    """Column names, and the rows as sorted text: nulls alike, whole numbers without a point."""
    def tidy(v):
        if v is None or pd.isna(v):
            return ""
        return str(int(v)) if isinstance(v, (int, float)) and v == int(v) else f"{v:.6g}" if isinstance(v, float) else str(v)

    names = sorted(frame.columns)
    return names, sorted("|".join(map(tidy, r)) for r in frame[names].astype(object).itertuples(index=False))


@needs_data
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    if name not in queries.ORACLE_SQL:
        assert got.count() >= 0
        return
    import duckdb

    con = duckdb.connect()
    for t in "orders customer events documents benchmark labels pages".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert rows(got.toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())
