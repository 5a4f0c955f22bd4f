"""The registry against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from paralex.plans import oracle, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (int, float)) else str(x)
    return sorted((tuple(value(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.SQL)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(oracle.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
