"""Registered queries against their SQL on the smallest driver tables."""

import pathlib

import pytest

import __spark_entry__ as entry

SF = pathlib.Path("/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, cols):
    return sorted(repr(tuple(r[c] for c in cols)) for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, str(SF)).toArrow().to_pylist()
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert got or not want
    cols = sorted(names)
    if got:
        assert sorted(got[0]) == cols
    assert canonical(got, cols) == canonical(want, cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
