"""Every registered query that has SQL, compared with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from waymark.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return f"{float(v):.9g}" if isinstance(v, float) or (hasattr(v, "dtype") and "float" in str(v.dtype)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), db.execute(SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
