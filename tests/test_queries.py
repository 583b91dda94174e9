"""Every query against its DuckDB twin, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from gridloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = [tuple(float(r[k]) if isinstance(r[k], float) else r[k] for k in order) for r in rows]
    return sorted(clean, key=lambda r: tuple(round(x, 4) if isinstance(x, float) else str(x) for x in r))


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    for flag in ("same", "exact"):
        if flag in df.columns:
            assert all(r[sorted(df.columns).index(flag)] for r in got), flag
    if name not in plans.oracle_sql():
        return
    cursor = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = _rows(columns, cursor.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(_same(x, y) for x, y in zip(g, w)), (g, w)
