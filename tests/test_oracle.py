"""Every registered query with oracle SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

import paperlume.operators  # noqa: F401
from paperlume.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=str)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(_plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
