"""Every query with SQL gives the rows DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from hopweave.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = sorted(f.removesuffix(".parquet") for f in os.listdir(SF) if f.endswith(".parquet"))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def show(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, float):
            return f"{x + 0.0:.9g}"
        return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)

    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_other_query_runs(spark):
    for name in sorted(QUERIES.keys() - ORACLES.keys()):
        assert QUERIES[name](spark, SF).count() > 0, name
