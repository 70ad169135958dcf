"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from quarry.plans.registry import load_all
from quarry.sources.tables import TABLES

SF = os.environ.get("QUARRY_TEST_SF", "/root/testdata/sf0.001")
QUERIES = {k: v for k, (v, _sql) in load_all().items()}
SQL = {k: v for k, (_fn, v) in load_all().items() if v}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_point_lists_the_library():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only == {"i1_model_call", "i4_embedding"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    sc, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[name])
    dc, dr = _rows([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert sr == dr


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "success" in df.columns
