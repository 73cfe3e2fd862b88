"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from grainwise import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(df):
    def text(v):
        if pd.isna(v):
            return ""
        if isinstance(v, float):
            return f"{v + 0.0:.5f}"
        return f"{v:.5f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.SQL) - {"chunk_ranges"}))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
