"""Every registered query with an SQL twin against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from timberline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    assert sorted((tuple(plain(r[i]) for i in place) for r in got.fetchall()), key=repr) == mine
    assert mine


def test_entry(spark):
    assert catalog.entry(spark, SF).count() == 4
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
