"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import chronoview.queries  # noqa: F401
from chronoview.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = [c for c in got.columns if pd.api.types.is_numeric_dtype(got[c]) and pd.api.types.is_numeric_dtype(want[c])]
    got[numbers], want[numbers] = got[numbers].astype(float), want[numbers].astype(float)
    assert rows(got) == rows(want)


#: What SQL does not express; tests of their own hold these against plain computations.
WITHOUT_SQL = {"f15_balance_by_length"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) | WITHOUT_SQL
