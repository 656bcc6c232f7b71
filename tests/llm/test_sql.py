"""Queries of the training-data operators with SQL against DuckDB, on whole test tables."""

import duckdb
import pytest

from boxloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    have = [c[0] for c in found.description]
    assert sorted(have) == sorted(df.columns)
    want = sorted(found.fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in df.select(*have).collect()), key=repr) == want
