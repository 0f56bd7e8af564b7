"""Every registered query of the library (the llm subpackage has its own tests) against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from airlens.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return str(value) if value.__class__.__name__ in ("Decimal", "date", "datetime") else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert df.columns
        return
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, want.fetchall())
