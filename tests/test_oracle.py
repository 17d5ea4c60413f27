"""Every query that has SQL gives the same rows as the SQL in another engine."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import CHECKED, SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


def rows(cols, records):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    df = QUERIES[name](spark, CHECKED)
    con = duckdb.connect()
    for f in glob.glob(f"{CHECKED}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
