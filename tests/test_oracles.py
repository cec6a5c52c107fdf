"""Every registered query against its SQL in DuckDB, on the same whole tables."""

import os

import duckdb
import pytest

from ratingloom.plans import catalog, oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

QUERIES, ORACLES = catalog.QUERIES, oracles.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}
    result = duck.sql(ORACLES[name])
    assert columns == sorted(result.columns)
    types = dict(zip(result.columns, map(str, result.types)))
    assert {c: kinds[t] for c, t in df.dtypes} == types
    want = result.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(want) and got
    assert sorted(got, key=key) == sorted(want, key=key)
