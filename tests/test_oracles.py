"""Every registered query against its SQL in DuckDB, on the small tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

from .conftest import SF

QUERIES = {k: v for k, v in __spark_entry__.queries().items() if not k.startswith("op") or not k[2:3].isdigit()}
QUERIES.pop("pipeline", None)
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def cell(x):
    if pd.isna(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return round(float(x), 6) + 0.0 if isinstance(x, (int, float, np.integer, np.floating)) else str(x)


def rows(df):
    return sorted(repr(tuple(map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert list(got.columns)
        return
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.filter("value not in (10.0, -10.0, 0.0)").count() == 0
