from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import numtheory, packing, rans
from gridloom.operators import cost, corpus, fits
from gridloom.sources import container, files


def test_rans_golden_bytes():
    freqs = [0] * 63
    for s, f in ((0, 683), (5, 1365), (31, 1365), (62, 683)):
        freqs[s] = f
    stream = rans.encode([5, 0, 62, 31, 5, 31], rans.Table(tuple(freqs), 4096))
    assert stream.hex() == "e50b63f6fb"


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 14), min_size=1, max_size=400))
def test_rans_round_trips(symbols):
    table = rans.Table.of(symbols, 15, 4096)
    assert sum(table.freqs) == 4096
    assert rans.decode(rans.encode(symbols, table), len(symbols), table).tolist() == symbols
    nine = rans.Table.of([s % 9 for s in symbols], 9, rans.NINE_TOTAL)
    digits, state = rans.encode_nine([s % 9 for s in symbols], nine)
    assert rans.unpack_nine(rans.pack_nine(digits), len(digits)) == digits
    assert rans.decode_nine(digits, state, len(symbols), nine).tolist() == [s % 9 for s in symbols]


def test_rans_many_lanes_alike():
    rng = np.random.default_rng(3)
    for total, k in ((4096, 63), (4096, 2), (256, 9)):
        rows = np.minimum(rng.geometric(0.3, (50, 200)) - 1, k - 1)
        table = rans.Table.of(rows.reshape(-1), k, total)
        streams = rans.encode_many(rows, table)
        assert streams == [rans.encode(r, table) for r in rows]
        assert (rans.decode_many(streams, 200, table) == rows).all()


def test_rans_refuses_nothing():
    with pytest.raises(ValueError):
        rans.normalized([0, 0], 4096)


@pytest.mark.parametrize("k", [9, 11, 13, 15, 17, 27, 63, 99])
@pytest.mark.parametrize("shape", [(1, 256), (3, 512), (17, 768)])
def test_blocks_are_exact(k, shape):
    rng = np.random.default_rng(k)
    digits, m = rng.integers(0, k, shape), rng.random((shape[0], shape[1] // 64)).astype(np.float32)
    kind = packing.block_type(k)
    blob = packing.pack_blocks(digits, k, m)
    assert len(blob) == shape[0] * shape[1] // 256 * packing.BLOCK_BYTES[kind]
    weights, codes, scales = packing.unpack_blocks(blob, *shape, kind)
    assert (codes == digits - (k - 1) // 2).all()
    assert (weights == np.repeat(scales, 64, axis=1) * codes).all()


@pytest.mark.parametrize("mode,error", [("fp32", 0), ("fp16", 1e-3), ("ent8", 2e-2)])
@pytest.mark.parametrize("k", [9, 15, 27, 63, 99])
def test_container(mode, error, k):
    rng = np.random.default_rng(1)
    tensors = [{"name": f"t{n}", "shape": s, "k": k, "group": 64, "mode": mode, "digits": rng.integers(0, k, s[0] * s[1]), "scales": (rng.random(s[0] * s[1] // 64) + 0.1).astype(np.float32), "perm": np.arange(s[1]) if k == 63 else None} for n, s in enumerate([(96, 192), (64, 256)])]
    data = container.write(tensors)
    assert data == container.write(tensors)
    for t, r in zip(tensors, container.directory(data)):
        digits, scales, perm = container.tensor(data, r)
        assert r["name"] == t["name"] and r["shape"] == list(t["shape"]) and (digits == t["digits"]).all()
        assert np.abs(scales / t["scales"] - 1).max() <= error
        assert (perm is None) == (k != 63)
    with pytest.raises(ValueError):
        container.directory(b"XXXX" + data[4:])


def test_container_source(spark, tmp_path):
    rng = np.random.default_rng(2)
    tensors = [{"name": n, "shape": (4, 64), "k": 9, "group": 64, "mode": "fp32", "digits": rng.integers(0, 9, 256), "scales": np.ones(4)} for n in ("a", "b")]
    (tmp_path / "x.bin").write_bytes(container.write(tensors))
    records = container.read_directory(spark, str(tmp_path))
    assert {r.name: r.k for r in records.collect()} == {"a": 9, "b": 9}
    assert container.summary(records).first().k_modal == 9
    rows = container.read_tensors(spark, str(tmp_path), ["b"]).collect()
    assert len(rows) == 1 and rows[0].digits == tensors[1]["digits"].tolist()


def test_expansions():
    assert numtheory.printed(*numtheory.expand(1, 7, 10)) == "0.(142857)"
    assert numtheory.printed(*numtheory.expand(1, 7, 9)) == "0.(125)"
    assert numtheory.printed(*numtheory.expand(1, 9, 10)) == "0.(1)"
    assert numtheory.printed(*numtheory.expand(1, 9, 9)) == "0.1"
    assert numtheory.printed(*numtheory.expand(1, 5, 10)) == "0.2"
    assert numtheory.printed(*numtheory.expand(1, 5, 9)) == "0.(17)"
    assert [numtheory.order(10, q) for q in (7, 11, 13, 37, 101)] == [6, 2, 6, 3, 4]
    assert [numtheory.order(9, q) for q in (7, 11, 13, 37, 101)] == [3, 5, 3, 9, 50]
    assert numtheory.periodicity([5, 1, 2, 1, 2, 1, 2]) == (2, 1)
    assert numtheory.family(80) == "3^4-1"


@settings(deadline=None, max_examples=100)
@given(st.integers(2, 199), st.integers(0, 198), st.sampled_from([9, 10]))
def test_expansions_are_exact(q, p, base):
    p %= q
    assert numtheory.value(base, *numtheory.expand(p, q, base)) == Fraction(p, q)


def test_fits():
    values = np.random.default_rng(42).standard_normal(20_000)
    centres = fits.lloyd_max(values, 9)
    assert (np.diff(centres) > 0).all()
    error = ((values - centres[np.searchsorted((centres[1:] + centres[:-1]) / 2, values)]) ** 2).mean()
    assert error < 0.05
    counts, edges = np.histogram(values, 512)
    _, low, many = fits.entropy_constrained(counts, (edges[1:] + edges[:-1]) / 2, 9, 0.0)
    _, high, few = fits.entropy_constrained(counts, (edges[1:] + edges[:-1]) / 2, 9, 0.1)
    assert low < high and few < many


def test_dumps(spark):
    whole = "### Name: P \n### Godot version: 4.2\n### Files:\nFile name: a.gd\n\n```gdscript\nx\n\ny\n```\nFile name: b.txt\nno block\nFile name: c.gd\n```\nz\n```\nFile name: e.gd\n```gd\n```\nFile name: a.gd\n```gdscript\nlast\n```\nFile name: open.gd\n```\nrest\n"
    cases = [whole, "", "### Name: only a head", "### Name:\n### Files:\nFile name: x\n```\n\n\n```", None]
    rows = spark.createDataFrame([(t,) for t in cases], "value string")
    got = sorted(tuple(r) for r in corpus.parse_dumps(rows).collect())
    assert got == sorted([("P", "4.2", "a.gd", "gdscript", "last"), ("P", "4.2", "c.gd", "", "z"), ("P", "4.2", "e.gd", "gd", ""), ("P", "4.2", "open.gd", "", "rest\n"), ("?", "?", "x", "", "\n")])
    long = "### Files:\nFile name: l.gd\n```gd\n" + "line of code\n" * 50_000 + "```\n"
    assert corpus.parse_dumps(spark.createDataFrame([(long,)], "value string")).first().content == ("line of code\n" * 50_000)[:-1]


def test_compensation_against_a_loop(spark):
    rng = np.random.default_rng(5)
    w = rng.standard_normal((12, 64))
    rows = spark.createDataFrame([(0, i, [float(x) for x in r]) for i, r in enumerate(w)], "tensor int, row long, v array<double>").repartition(3)
    h = fits.gram_matrix(rows)
    assert np.allclose(h, 2 * w.T @ w / 12)
    u = fits.damped_inverse(h)
    assert np.allclose(u.T @ u, np.linalg.inv(h + 0.01 * np.mean(np.diag(h)) * np.eye(64)))
    got = {r.row: r for r in fits.compensated(rows, h, 9).collect()}
    for i, r in enumerate(w):
        r, m = r.copy(), np.abs(r).max()
        for j in range(64):
            d = int(np.clip(np.rint((r[j] + m) / (2 * m / 8)), 0, 8))
            assert got[i].d[j] == d
            r[j + 1 :] -= (r[j] - (d * 2 * m / 8 - m)) / u[j, j] * u[j, j + 1 :]


def test_allocation_is_greedy(spark):
    sizes = {("a", 9): (10.0, 9.0), ("a", 15): (14.0, 4.0), ("a", 63): (30.0, 1.0), ("b", 9): (10.0, 8.0), ("b", 15): (13.0, 7.0), ("b", 63): (20.0, 0.5)}
    rows = spark.createDataFrame([(t, k, *x) for (t, k), x in sizes.items()], "tensor string, k int, bytes double, err double")
    for budget in (20.0, 24.0, 34.0, 50.0, 99.0):
        got = cost.allocate(rows, budget, 9)
        assert sum(sizes[t, k][0] for t, k in got.items()) <= budget
        levels = {"a": 9, "b": 9}
        while True:
            spent = sum(sizes[t, k][0] for t, k in levels.items())
            ups = [((sizes[t, levels[t]][1] - e) / (b - sizes[t, levels[t]][0]), t, k) for (t, k), (b, e) in sizes.items() if k > levels[t] and e < sizes[t, levels[t]][1] and spent + b - sizes[t, levels[t]][0] <= budget]
            if not ups:
                break
            _, t, k = max(ups)
            levels[t] = k
        assert got == levels


def test_feedback_carries_vectors(spark):
    rng = np.random.default_rng(3)
    w = rng.standard_normal((5, 256))
    w[0, :64] = 0
    rows = spark.createDataFrame([(0, i, [float(x) for x in r]) for i, r in enumerate(w)], "tensor int, row long, v array<double>")
    got = {r.row: np.array(r.q) for r in fits.with_feedback(rows, 9, feedback=0.7).collect()}
    for i, r in enumerate(w):
        carry = np.zeros(64)
        for b in range(4):
            own = r[64 * b : 64 * b + 64]
            m = float(np.float16(np.abs(own).max())) or 1.0
            q = m * (np.clip(np.rint((own + 0.7 * carry) / m * 4 + 4), 0, 8) - 4) / 4
            assert np.allclose(got[i][64 * b : 64 * b + 64], q)
            carry = own - q


def test_file_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows = files.jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()
    assert sorted(r.a for r in rows if r.a is not None) == [1, 2] and sum(r._corrupt_record is not None for r in rows) == 1
    (tmp_path / "bad.txt").write_bytes(b"ok \xff end")
    assert files.whole_texts(spark, str(tmp_path / "bad.txt")).first().value == "ok � end"
    (tmp_path / "log.txt").write_text("x\nPPL = 12.5 +/- 0.1\n")
    assert files.matched_fields(spark, str(tmp_path / "log.txt"), {"ppl": r"PPL = ([0-9.]+)"}).first().value == 12.5
    (tmp_path / "w.hex").write_text("00ff // c\n\n10\n")
    assert sorted(r.word for r in files.hex_words(spark, str(tmp_path / "w.hex")).collect()) == [16, 255]
    (tmp_path / "p.txt").write_text("v,1,0.5\nnoise\np,2,1.5\n")
    assert sorted(tuple(r) for r in files.probe_lines(spark, str(tmp_path / "p.txt")).collect()) == [("p", 2, 1.5), ("v", 1, 0.5)]


def test_streaming_first_seen(spark, tmp_path):
    from gridloom.streaming import folds

    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as ts, cast(id % 3 as string) as text from range(9)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = folds.first_seen(stream, "text", "ts", "1 hour").writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) c from seen").first().c == 3
