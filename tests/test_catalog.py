"""Every registered query runs on the smallest tables; those with comparison SQL must give its rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from statloom.catalog import all_queries

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        res = db.execute(SQL[name])
        assert got == rows([c[0] for c in res.description], res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names():
    assert set(SQL) <= set(QUERIES)
    # the text operators come from a subpackage of their own, which may be missing
    assert not any(n.startswith("op") and n[2:3].isdigit() or "pipeline" in n for n in all_queries())
