"""Every registered query runs over the smallest tables, and agrees with its SQL where it has any."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from plumeline import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "" if v is None or v != v else str(float(v)) if isinstance(v, (int, float, np.number, bool, np.bool_)) else str(v))
    return sorted(map(tuple, frame.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
    else:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 1


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
