"""The SQL of the subpackage's queries gives what the queries give."""

import duckdb
import pytest

from parlance.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    columns = sorted(names)
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))
