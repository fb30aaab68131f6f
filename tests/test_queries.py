"""Every registered query runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
CORE = [q for q in QUERIES if not q.startswith("p") or not q[1].isdigit()]


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else (round(float(v), 6) if isinstance(v, float) else str(v))
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_core_query_agrees_with_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_names_and_entry(spark):
    assert set(SQL) <= set(QUERIES)
    assert __spark_entry__.entry(spark).count() > 0
