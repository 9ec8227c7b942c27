"""The columns that SQL can express, and all of the SQL, on the smallest tables."""

import glob
import os

import pytest

from arterial.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    shown = lambda v: str(round(v, 3) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_agrees_with_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
