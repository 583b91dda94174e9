"""Queries against their DuckDB twins on small tables made for one case each."""

from __future__ import annotations

import math

import duckdb

from gridloom import plans


def _both(spark, tmp_path, name, **tables):
    """(Spark's rows, DuckDB's rows), sorted, columns in the order of the SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    cursor = con.execute(plans.oracle_sql()[name])
    want = sorted(cursor.fetchall())
    got = plans.queries()[name](spark, str(tmp_path)).select([c[0] for c in cursor.description])
    return sorted(tuple(r) for r in got.collect()), want


def test_line_quality_of_empty_texts(spark, tmp_path):
    texts = ["", None, "\n", "abc " * 100, "\n" * 400, "a" * 7999 + "\n", "é" * 200, "ab-" * 3000, "x" * 150 + "\n" + "- " * 100]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = _both(spark, tmp_path, "line_quality", documents=d)
    assert got == want and got


def test_coded_rate_of_short_lanes(spark, tmp_path):
    vectors = [(i, [math.sin(97.0 * i + j * j) for j in range(64)], int(i < 65)) for i in range(70)] + [(70, [0.5] * 64, 2)]
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got, want = _both(spark, tmp_path, "coded_rate", embeddings=e)
    assert got == want and {r[2] for r in got} == {64, 320, 4096}


def test_offset_audit_rounds_half_to_even(spark, tmp_path):
    prices = [12850.0, 12950.0, 15950.0, 16050.0, 3250.0, 9650.0]
    o = spark.createDataFrame([(13 * i, i % 2, p) for i, p in enumerate(prices + prices)], "o_orderkey long, o_custkey long, o_totalprice double")
    got, want = _both(spark, tmp_path, "offset_audit", orders=o)
    assert got == want and len(got) == 12


def test_read_path_where_the_last_bit_decides(spark, tmp_path):
    """Rows whose largest output was half way between two steps in one engine and just beside it in the other."""
    vectors = [(i, [math.sin(97.0 * i + j * j) for j in range(64)], i % 10) for i in (30727, 47702, 49456)]
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got, want = _both(spark, tmp_path, "read_path", embeddings=e)
    assert got == want and len(got) == 192


def test_rows_in_order_writes_shards_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gridloom.plans.files.SHARD", 10_000, raising=False)
    monkeypatch.setattr("gridloom.sources.work.fresh", lambda spark, name: f"{tmp_path}/out/{name}")
    d = spark.createDataFrame([(7 * i % 1000, None if i % 50 == 3 else "x" * 100) for i in range(1000)], "doc_id long, text string")
    got, want = _both(spark, tmp_path, "rows_in_order", documents=d)
    assert got == want and len(got) == 1000
    assert len(list((tmp_path / "out" / "shards").glob("part-*"))) == 10


def test_rows_in_order_of_no_rows(spark, tmp_path):
    got, want = _both(spark, tmp_path, "rows_in_order", documents=spark.createDataFrame([], "doc_id long, text string"))
    assert got == want == []
