"""Every registered query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items()}


def plain(v):
    if v is pd.NA or v is pd.NaT or v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, str):
        return v
    return f"{float(v):.6g}"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL and not n.startswith(("op", "pipeline"))))
def test_runs(spark, name):
    """Queries that SQL cannot express; tests of their operators hold them against brute force."""
    found = entry.queries()[name](spark, FOLDER)
    assert found.columns and found.count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 20
