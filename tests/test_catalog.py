"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalog, codes, linking, links, past, search, shapes  # noqa: F401 - they register queries
from tessera.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(5) + 0.0
        df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v != v else str(v))
    return sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
