"""Every query with SQL gives what DuckDB gives for it."""

import duckdb
import pandas as pd
import pytest

from parlance.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "benchmark customer events documents embeddings lineitem nation orders conversations pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if v is None or v is pd.NA or v != v:
        return None
    return f"{float(v):.6f}" if not isinstance(v, str) else v


def rows(df):
    return sorted((tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    assert len(got)
