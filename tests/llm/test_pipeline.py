"""The pipeline's rows against plain versions of its stages."""

from __future__ import annotations

import hashlib

import duckdb

import corpus_pipeline
from gridloom.llm import queries
from tests.llm.test_llm import PATTERN, RANKS, SF, _brute_hits, _brute_lines, _sets


def test_pipeline(spark):
    import tiktoken

    from gridloom.llm import bpe

    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    # letters decide here; posteriors are held against brute force in test_llm.py
    docs = [r for r in docs if any(c.isalpha() for c in r.text)]
    ids, texts = [r.doc_id for r in docs], [r.text for r in docs]
    gone = _brute_lines(texts, 50)
    rows = []
    for i, t, g in zip(ids, texts, gone):
        left = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g) if g else t
        if not g or left.strip():
            rows.append((i, left))
    sets = _sets([t for _, t in rows], 5)
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                k = len(sets[i] & sets[j])
                if k and root[i] != root[j] and 5 * k >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    rows = [r for n, r in enumerate(rows) if root[n] == n]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = _brute_hits([t for _, t in rows], items)
    clean = [r for n, r in enumerate(rows) if not hits[n][2]]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = {i: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean for x in [library.encode_ordinary(t)]}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_pipeline_odd(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and long texts, an empty table and names that the stages use themselves."""
    long = "the word and " * 5_000
    rows = [(1, None, None, None, None), (None, "null id text the of", "en", None, 3), (2, "", "", "", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "é ü ß 日本", "xx", "s", 9), (5, "the cat and the dog\nthe cat", "en", "t", 20)]
    names = ["id", "items", "spans", "n_words", "emptied", "n_removed", "_doc", "_h", "_key", "_gone", "h", "n", "c0"]
    docs = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    spark.createDataFrame([(1, "not in any of them")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert (False, 1) not in got and (False, 2) not in got and (True, 0) in got and (False, 5) in got
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == len(got)


def test_query_twins(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), name
