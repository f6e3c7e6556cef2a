"""Driver contract: entry runs; every query agrees with its oracle SQL on the smallest fixture."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from hirelens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
# the training-data queries have their own tests
NAMES = [n for n in E.queries() if not n.startswith("op") and n != "pipeline"]


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_oracle(spark, duck, name):
    out = E.queries()[name](spark, SF)
    assert len(out.columns) == len(set(out.columns))
    rows = [tuple(r) for r in out.collect()]
    rel = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert rows and sorted(cols) == sorted(out.columns)
    assert _digest(rows, out.columns) == _digest(rel.fetchall(), cols)
