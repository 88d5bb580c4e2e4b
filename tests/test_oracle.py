"""Every query with an SQL twin gives the twin's rows, on tables with rows for every branch."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracemill.plans import catalogue

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    twin = db.execute(catalogue.ORACLE[name])
    names = [c[0] for c in twin.description]
    assert sorted(names) == sorted(df.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert a == sorted(tuple(map(plain, r)) for r in twin.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
