"""Registered raster queries against their DuckDB equals on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fieldshift.plans.oracles import ORACLES
from fieldshift.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(D).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
