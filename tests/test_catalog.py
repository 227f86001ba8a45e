"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from logloom.plans import catalog


def normal(df):
    df = df.reindex(sorted(df.columns), axis=1)
    df = df.map(lambda v: None if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_same_as_duckdb(spark, tiny, duck, name):
    got = normal(catalog.queries()[name](spark, tiny).toPandas())
    want = normal(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
