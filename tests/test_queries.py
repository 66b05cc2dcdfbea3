"""Every registered query gives the rows of its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def _rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 5) + 0.0)
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(SQL) - {n for n in SQL if n[0] == "p" and n[1].isdigit()}) + sorted(n for n in SQL if n[0] == "p" and n[1].isdigit()))
def test_same_rows(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not (n[0] == "p" and n[1].isdigit())))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
