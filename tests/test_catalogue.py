"""Every query with SQL gives DuckDB's rows, column names included."""

import math

import duckdb
import pandas as pd
import pytest

from tidewell.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_range_filter_reaches_the_scan(spark):
    plan = catalogue.QUERIES["kv_range_scan"](spark, DATA)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(user_id,10)" in plan and "LessThan(user_id,60)" in plan
