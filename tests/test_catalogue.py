"""Every query next to its SQL check at the smallest scale, and the driver contract."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
_spec = importlib.util.spec_from_file_location(
    "compare", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "compare.py")
)
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(compare.cell(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, FOLDER).toPandas()
    assert len(frame) > 0
    if name in ORACLES:
        want = db.execute(ORACLES[name]).fetch_df()
        assert sorted(frame.columns) == sorted(want.columns)
        assert rows(frame) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
