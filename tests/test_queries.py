"""Every query of the library with an oracle gives what DuckDB gives on the smallest tables."""

import glob
import importlib
import os
import pkgutil

import duckdb
import pytest

import foliant.plans

FOLDER = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"foliant.plans.{m.name}") for m in pkgutil.iter_modules(foliant.plans.__path__)]
QUERIES = {n: f for m in MODULES for n, f in getattr(m, "QUERIES", {}).items()}
SQL = {n: t for m in MODULES for n, t in getattr(m, "SQL", {}).items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def canon(rows):
    show = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted("|".join(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows
    if name in SQL:
        listed = ", ".join(f'"{c}"' for c in columns)
        want = duck.execute(f"SELECT {listed} FROM ({SQL[name]}) q").fetchall()
        assert canon(rows) == canon(want)
