"""The training-data operators against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, chosen_path, components, decontam, gam, hmm, langid, queries, secret_ledger, spotsigs, winnow

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, rid long"
# names that the operators use within or give to their own columns
CLASH = "items long, spans long, n_words long, emptied boolean, n_removed long, _doc long, _th long, _h long, _key long, _gone long, h long, seq long, said long"
public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, 2, 3) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(40)]
    near = []
    for t in base:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            near.append(" ".join(v))
    out = base + near + base[:5] + [None, "", "   ", "one", "One", "two words", "x" * 5000, "A b C d E"]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, an empty and a very long text, clashing column names."""
    long = "the word and " * 20_000
    rows = [(1, None, None, None, None), (None, "null id text the of", "en", None, 3), (2, "", "", "", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "é ü ß \U0001f600 日本", "xx", "s", 9), (-5, "the cat and the dog\nthe cat", "fr", "t", 20)]
    rows = [(*r, 1, 2, 3, *[None] * (CLASH.count(",") + 1)) for r in rows]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASH}")


# --- 5 ------------------------------------------------------------------------------------------------


def _sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("small,block", [(32, 256), (2, 4)])
def test_near_duplicates(spark, texts, small, block):
    sets = _sets(texts, 4)
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for i, j in itertools.combinations(range(len(texts)), 2):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    got = {r.doc_id: r for r in chosen_path.near_duplicates(_frame(spark, texts), width=4, small=small, block=block).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == root
    assert all(got[i].kept == (root[i] == i) for i in got)


def test_large_leaves_are_exact(spark):
    """Copies whose likeness to one another is about the threshold, in nodes larger than the limits."""
    rnd = random.Random(3)
    base = [str(n) for n in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(60)] = f"x{rnd.random()}"
        texts.append(" ".join(w))
    test_near_duplicates(spark, texts, 2, 4)


def test_documents_of_the_first_and_last_cell(spark, monkeypatch):
    size = chosen_path.LEAST_BITS
    cell = F.pmod(F.xxhash64("id"), F.lit(size))
    last = spark.range(20_000_000).where(cell == size - 1).first().id
    ids = [25317696, last, 7, 8]
    assert spark.createDataFrame([(25317696,)], "id long").select(cell).first()[0] == 0
    words = [f"w{k}" for k in range(100)]
    docs = _frame(spark, [" ".join(words), " ".join([*words[:99], "other"]), " ".join([*words[:98], "more"]), "alone"], ids)
    sets = chosen_path._sets_of(docs.select("doc_id").where("doc_id <> 8"), docs, 4).collect()
    assert sorted(r.id for r in sets) == sorted(ids[:3])
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs, num=4, den=5, width=4).collect()}
    assert got == {25317696: 7, last: 7, 7: 7, 8: 8}
    monkeypatch.setattr(chosen_path, "LEAST_BITS", 8)
    monkeypatch.setattr(chosen_path, "MOST_BITS", 8)  # too full a map: the ids are joined to the texts first
    assert sorted(r.id for r in chosen_path._sets_of(docs.select("doc_id").where("doc_id <> 8"), docs, 4).collect()) == sorted(ids[:3])


def test_near_duplicates_odd(spark, odd):
    rows = {(r.doc_id, r.n_shingles): r for r in chosen_path.near_duplicates(odd, width=4).collect()}
    assert rows[1, 0].component_id == 1 and rows[2, 0].kept
    assert rows[None, 2].component_id is None and not rows[None, 2].kept
    assert chosen_path.drop_near_duplicates(odd).columns == odd.columns
    assert chosen_path.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (None, 1), (2, 1)] + [(100, n) for n in range(101, 160)] + [(n, n + 1) for n in range(200, 260)]
    got = {r.v: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 1 for n in (1, 2, 3, 4)}, **{n: 8 for n in (8, 9, 10)}, **{n: 100 for n in range(100, 160)}, **{n: 200 for n in range(200, 261)}}


# --- 6 ------------------------------------------------------------------------------------------------


def _brute_lines(texts, least):
    docs = [[(p, x.strip(" \t\r")) for p, x in enumerate((t or "").split("\n"))] for t in texts]
    docs = [[(p, x, x.count(" ") + 1) for p, x in d if x] for d in docs]
    seen, gone = {}, [set() for _ in docs]
    runs = []
    for n, d in enumerate(docs):
        for i in range(len(d)):
            for j in range(i, len(d)):
                if sum(w for *_, w in d[i : j + 1]) >= least:
                    runs.append((n, i, j, tuple(x for _, x, _ in d[i : j + 1])))
    for n, i, _, body in runs:
        seen[body] = min(seen.get(body, (n, i)), (n, i))
    for n, i, j, body in runs:
        if seen[body] != (n, i):
            gone[n].update(p for p, *_ in docs[n][i : j + 1])
    return gone


def test_repeated_lines(spark):
    rnd = random.Random(8)
    lines = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 9))) for _ in range(25)] + ["", "  "]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 14))) for _ in range(60)] + [None, ""]
    gone = _brute_lines(texts, 12)
    assert any(gone)
    got = {r.doc_id: r for r in winnow.deduplicate_lines(_frame(spark, texts), 12).collect()}
    for n, t in enumerate(texts):
        want = t if t is None or not gone[n] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[n])
        assert got[n].text == want and got[n].n_removed == len(gone[n])
        assert got[n].emptied == (bool(gone[n]) and not want.strip())


def test_repeated_lines_odd(spark, odd):
    done = winnow.drop_repeated_lines(odd)
    assert done.columns == odd.columns and done.count() == odd.count()
    assert winnow.deduplicate_lines(odd.limit(0)).count() == 0


def test_repeated_lines_count_words_not_spaces(spark):
    rows = "\n".join("\t".join(f"c{r}x{c}" for c in range(5)) for r in range(30))
    padded = "name" + " " * 60 + "value"
    texts = [rows, "own line\n" + rows, padded, "other line\n" + padded, "\x0b \f", "a\x0bb\fc  d \t e"]
    got = {r.doc_id: r for r in winnow.deduplicate_lines(_frame(spark, texts)).collect()}
    assert got[1].text == "own line" and (got[1].n_removed, got[1].words_removed) == (30, 150)
    assert all(got[n].text == texts[n] and got[n].n_removed == 0 for n in (0, 2, 3, 4, 5))
    assert [r.w for r in winnow._lines(_frame(spark, texts[4:])).orderBy("_doc").collect()] == [0, 5]


# --- 2 ------------------------------------------------------------------------------------------------

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _brute_hits(texts, items, width=8):
    low = lambda t: re.findall(_WORDS, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = low(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                owners = windows.get(tuple(w[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    found |= owners
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_contamination(spark, block_bytes):
    rnd = random.Random(2)
    words = ["a", "b", "cc", "Ünï", "日本", "x1", "the"]
    texts = [rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 120))) for _ in range(50)] + [None, "", "A-b!CC"]
    items = [(n, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 8, 9, 20])))) for n in range(12)]
    items += [(50, texts[0][: len(texts[0]) // 2]), (51, ""), (52, None), (50, "a b cc a b")]
    frame = spark.createDataFrame([(*x, 1) for x in items] + [(None, "a", 1)], "item_id long, text string, doc_id long")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.contamination(_frame(spark, texts), frame, block_bytes=block_bytes).collect()}
    assert [got[n] for n in range(len(texts))] == _brute_hits(texts, items)


def test_contamination_odd(spark, odd):
    items = spark.createDataFrame([(1, "the word and the word and the word")], "item_id long, text string")
    assert decontam.contamination(odd, items).count() == odd.count()
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontam.contamination(odd, items.limit(0)).where("n_items > 0").count() == 0
    assert decontam.contamination(odd.limit(0), items).count() == 0


def test_part_of_an_item_is_dropped(spark):
    item = [f"w{k}" for k in range(59)]
    texts = ["before " + " ".join(item[10:41]) + " after", " ".join(item[:8]), " ".join(item[:7]) + " x " + " ".join(item[7:14]), "clean", "short item"]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "Short, item!")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.drop_contaminated(_frame(spark, texts), items).collect()) == [2, 3]


# --- 4 ------------------------------------------------------------------------------------------------


def test_bpe_matches_the_library(spark, odd):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    parts = ["the", "a", " ", "  ", "é", "ß", "漢", "ing", "\n", "9", "!!", "Z", "ü", "\U0001f600", "q", "zzzz", " ", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["a" * 3000, "ab" * 900]
    coder = bpe.codec(RANKS, PATTERN)
    for text, made in zip(texts, coder.encode(texts)):
        ids = [int(i) for i in made.split()]
        assert ids == library.encode_ordinary(text)
        assert coder.decode(made) == text == coder.decoder.decode(ids)
    rows = bpe.round_trip(odd, RANKS, PATTERN).collect()
    assert len(rows) == odd.count()
    for r, text in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), [x.text for x in sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))]):
        ids = library.encode_ordinary(text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd.collect())


def test_bpe_bounded_caches(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 40)
    monkeypatch.setattr(bpe, "MAX_FITS", 30)
    monkeypatch.setattr(bpe, "MAX_HELD", 1500)
    small, big = bpe.Codec(bpe.read_ranks(RANKS), PATTERN), bpe.codec(RANKS, PATTERN)
    texts = ["reproducible tokenisation overlapping zzxyq", "unbelievably übermäßig naïveté"]
    for _ in range(4):
        assert small.encode(texts) == big.encode(texts)
        assert [small.encode([t])[0] for t in texts] == big.encode(texts)
    assert len(small.known) + len(small.old) < 12
    small.forget()
    assert not small.known and small.encode(texts) == big.encode(texts)


def test_stream_decoder():
    decoder = bpe.StreamDecoder({0: b"\xf0\x9f", 1: b"\x98\x80", 2: b"a", 3: b"\xff", 4: b"\xc3"})
    assert decoder.decode([0, 1, 2]) == "\U0001f600a"
    assert decoder.decode([0, 2, 3, 4]) == "�a��"


# --- 1 ------------------------------------------------------------------------------------------------


def test_language_id(spark, odd):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(docs) and np.mean([docs[r.doc_id] == r.language for r in got]) > 0.98
    assert np.mean([r.accepted for r in got]) > 0.98
    pages = queries.op1_pages_language_id(spark, SF).collect()
    assert np.mean([r.accepted for r in pages]) > 0.95
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.unionByName(odd.select(docs.columns))
    out = langid.identify(rows.select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("host"), F.lit("com").alias("suffix")))
    assert out.count() == rows.count()
    none = langid.identify(odd.limit(0).select("id", "text", "lang", F.col("source").alias("host"), F.col("lang").alias("suffix")))
    assert none.count() == 0


def test_language_id_keeps_every_language(spark):
    """70 languages of a script each, tags in several spellings, and one rare beside a common one."""
    rnd = random.Random(4)

    def text(k):
        return " ".join("".join(chr(0x4E00 + 40 * k + rnd.randrange(12)) for _ in range(4)) for _ in range(30))

    tag = lambda k: f"{chr(97 + k // 26)}{chr(97 + k % 26)}"
    rows = [(n, text(k), t, tag(k)) for n, (k, t) in enumerate((k, t) for k in range(70) for t in (tag(k), tag(k).upper(), f"{tag(k)}-US", f" {tag(k)}_x"))]
    rows += [(1000 + n, text(0), "aa", "aa") for n in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, want string").repartition(3)
    for sample in (langid.SAMPLE, 5):
        got = langid.identify(docs.select("id", "text", "lang", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("suffix")), sample=sample)
        want = {r[0]: r[3] for r in rows}
        assert all(r.accepted and r.language == want[r.id] for r in got.collect())
    names, _ = langid.fit_text(docs.withColumn("lang", langid.tag_of(F.col("lang"))), 5)
    assert names == sorted(set(want.values()))
    odd = spark.createDataFrame([(t,) for t in ("i-klingon", "x_Own", "zh-Hant-TW", "", " ", None)], "t string")
    assert [r[0] for r in odd.select(langid.tag_of(F.col("t"))).collect()] == ["i-klingon", "x-own", "zh", None, None, None]


# --- 3 ------------------------------------------------------------------------------------------------


def test_posteriors_by_hand(spark):
    """Every posterior against the formula worked out in plain Python: wrong, missing and unknown declarations, hosts and suffixes."""
    words = {"en": "the cat and the dog sat with them", "de": "der hund und die katze sind hier oft", "fr": "le chien et le chat sont dans la maison"}
    rows = []
    for k in range(60):
        lang = ["en", "de", "fr"][k % 3]
        declared = None if k % 7 == 0 else "en-US" if k % 11 == 0 else lang
        host = [None, "a.de", "b.fr", "c.com", "localhost"][k % 5]
        rows.append((k, " ".join(words[lang].split()[: 2 + k % 7]), declared, host, host.rpartition(".")[2] if host and "." in host else None))
    rows += [(60, "", "en", "a.de", "de"), (61, "123 456", None, None, None), (62, None, "fr", "b.fr", "fr"), (63, "qqqq zzzz xxxx " * 9, "en", "c.com", "com")]
    frame = spark.createDataFrame(rows, "id long, text string, lang string, host string, suffix string")
    got = {r.id: r for r in langid.identify(frame).collect()}

    def cells(text):
        low = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()]
        hit = lambda a, b, c: ((a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)) >> 17
        return [hit(*low[i : i + 3]) for i in range(len(low) - 2) if low[i + 1] != 32]

    tag = lambda x: x and x.split("-")[0].lower()
    names = sorted({tag(r[2]) for r in rows if r[2]})
    count = {n: Counter(c for r in rows if tag(r[2]) == n and r[1] is not None for c in cells(r[1])) for n in names}
    size = {n: sum(count[n].values()) + 0.5 * langid.BUCKETS for n in names}
    ll = {r[0]: [langid.TEMPER * sum(math.log((count[n][c] + 0.5) / size[n]) for c in cells(r[1])) for n in names] for r in rows}
    letters = {r[0]: sum(c.isalpha() for c in r[1] or "") for r in rows}
    said = {r[0]: ll[r[0]].index(max(ll[r[0]])) for r in rows if letters[r[0]]}
    tally = lambda keep: [sum(1 for r in rows if said.get(r[0]) == j and keep(r)) for j in range(len(names))]
    whole = tally(lambda r: True)
    flat = [(x + 1) / (sum(whole) + len(names)) for x in whole]
    smooth = lambda n, prior, s: [(x + s * p) / (sum(n) + s) for x, p in zip(n, prior)]
    for i, _, lang, host, suffix in rows:
        known = any(r[4] == suffix and r[0] in said for r in rows)
        prior = smooth(tally(lambda r: r[4] == suffix), flat, 10) if suffix and known else flat
        if host and any(r[3] == host and r[0] in said for r in rows):
            prior = smooth(tally(lambda r: (r[3], r[4]) == (host, suffix)), prior, 5)
        told = [math.log((a + 0.5) / (t + 1)) for a, t in zip(tally(lambda r: tag(r[2]) == tag(lang)), whole)] if lang and any(tag(r[2]) == tag(lang) and r[0] in said for r in rows) else [0] * len(names)
        score = [a + math.log(p) + e for a, p, e in zip(ll[i], prior, told)]
        none = langid.TEMPER * math.log(1 / langid.BUCKETS) * len(cells(next(r[1] for r in rows if r[0] == i))) + math.log(langid.NO_LANGUAGE)
        want = 1 / (sum(math.exp(x - max(score)) for x in score) + math.exp(none - max(score)))
        assert got[i].language == names[score.index(max(score))] and math.isclose(got[i].posterior, want, rel_tol=1e-4), (i, got[i], want)
        assert got[i].accepted == (letters[i] > 0 and want >= 0.5)


def _edited(texts):
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]


def test_fingerprints(spark, texts):
    plain = [t or "" for t in texts]
    got = {r.doc_id: r for r in spotsigs.fingerprints(_frame(spark, texts)).collect()}
    edited = _edited(plain)
    by = {}
    for n, t in enumerate(plain):
        assert got[n].n_chars == len(t)
        assert got[n].edited_sha256 == hashlib.sha256(edited[n].encode()).hexdigest()
        assert by.setdefault(t, got[n].fingerprint) == got[n].fingerprint
        assert 0 <= got[n].near_edited <= 1 and 0 <= got[n].near_next <= 1
        if t == plain[(n + 1) % len(plain)]:
            assert got[n].near_next == 1
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()])


def test_fingerprints_across_ranges(spark):
    texts = [f"the word{n} and other{n} of thing{n}" for n in range(700)]
    ids = [n * 1000 - 5000 for n in range(700)]
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprints(_frame(spark, texts, ids)).collect()}
    assert [got[i] for i in ids] == [hashlib.sha256(t.encode()).hexdigest() for t in _edited(texts)]


def test_fingerprints_odd(spark, odd):
    assert spotsigs.fingerprints(odd).count() == odd.count()
    assert spotsigs.fingerprints(odd.limit(0)).count() == 0
    assert spotsigs.fingerprints(_frame(spark, ["the " * 60_000, "the of and " * 30_000 + "x"])).count() == 2
    one = spotsigs.fingerprints(odd.where("doc_id = 2")).first()
    assert one.fingerprint == "" and one.near_next == 1


def test_near_pairs(spark, texts):
    frame = _frame(spark, texts)
    sigs = {r.doc_id: frozenset(r.s) for r in frame.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    first = {}
    for i in sorted(sigs):
        first.setdefault(sigs[i], i)
    want = set()
    for (a, i), (b, j) in itertools.combinations(sorted(first.items(), key=lambda x: x[1]), 2):
        if a and b and len(a & b) / len(a | b) >= 0.8:
            want.add((i, j))
    assert {(r.a, r.b) for r in spotsigs.near_pairs(frame).collect()} == want and want


# --- 7 ------------------------------------------------------------------------------------------------


def test_language_model(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})) + ["\0"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in queries.op7_hidden_markov(spark, SF).collect()}
    for i, r in rows.items():
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(words[i]), n)
        assert r.n_known == sum(counts[w] > 0 for w in words[i])
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i]), rel_tol=1e-9)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_forward_is_exact(spark):
    """The scaled recursion against the sum over all paths."""
    rng = np.random.default_rng(0)
    first, moves, emits = hmm._start()
    seq = rng.integers(0, hmm.CLASSES, 4).astype("<u2")
    want = sum(first[p[0]] * math.prod(moves[a, b] for a, b in zip(p, p[1:])) * math.prod(emits[s, x] for s, x in zip(p, seq)) for p in itertools.product(range(hmm.STATES), repeat=4))
    sent = spark.sparkContext.broadcast((first, moves, emits))
    got = spark.createDataFrame([(1, bytearray(seq.tobytes())), (2, bytearray(seq[:1].tobytes()))], "rid long, seq binary").mapInArrow(hmm._forward(sent), "rid long, hmm double").collect()
    assert math.isclose({r.rid: r.hmm for r in got}[1], math.log10(want), rel_tol=1e-9)


def test_language_model_odd(spark, odd):
    assert hmm.score_texts(odd, rounds=1).count() == odd.count()
    assert hmm.score_texts(odd.limit(0), rounds=1).count() == 0
    only = hmm.score_texts(_frame(spark, ["a b", None]), rounds=1).collect()
    assert all(r.score <= 0 for r in only)


@pytest.mark.parametrize("stretch", [1, 3, hmm.STRETCH])
def test_expected_counts_are_sums_over_paths(spark, stretch):
    """Baum-Welch's expected counts against a sum over all state paths of short sequences, whole and in stretches."""
    first, moves, emits = hmm._start()
    seqs = [[3, 1, 3, 0], [2, 0], [1], [5, 5, 0]]
    want = [np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.CLASSES, hmm.STATES))]
    for seq in seqs:
        paths = {}
        for path in itertools.product(range(hmm.STATES), repeat=len(seq)):
            p = first[path[0]] * emits[path[0], seq[0]]
            for k in range(1, len(seq)):
                p *= moves[path[k - 1], path[k]] * emits[path[k], seq[k]]
            paths[path] = p
        total = sum(paths.values())
        for path, p in paths.items():
            want[0][path[0]] += p / total
            for k, (state, seen) in enumerate(zip(path, seq)):
                want[2][seen, state] += p / total
                if k:
                    want[1][path[k - 1], state] += p / total
    sent = spark.sparkContext.broadcast((first, moves, emits))
    rows = spark.createDataFrame([(bytearray(np.array(s, "<u2").tobytes()),) for s in seqs], "seq binary").repartition(2)
    got = np.zeros(sum(w.size for w in want))
    for r in rows.mapInArrow(hmm._expect(sent, stretch), "i long, x double").collect():
        got[r.i] += r.x
    assert np.allclose(got, np.concatenate([w.reshape(-1) for w in want]), atol=2e-5)


# --- 8 ------------------------------------------------------------------------------------------------


def test_quality(spark, odd):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op8_additive_quality(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    marks = spark.createDataFrame([(3, 1, "x"), (None, 1, "x"), (-5, None, "x")], "doc_id long, quality int, text string")
    model = gam.train(odd, marks)
    assert gam.score_texts(odd, model).count() == odd.count()
    assert gam.train(odd, marks.limit(0)).score(np.zeros((1, len(gam.NAMES))))[0] == 0.5


def test_boosting_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(gam.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9


def test_scores_are_sums_of_tables():
    """Vectorised scoring and features against plain loops."""
    rng = np.random.default_rng(2)
    x = rng.random((600, len(gam.NAMES)))
    model = gam.fit(x, (x[:, 0] + x[:, 2] * x[:, 3] > 0.8).astype(float))
    for row, got in zip(x[:40], model.score(x[:40])):
        total = model.bias
        for k, (edge, table) in enumerate(zip(model.edges, model.tables)):
            total += table[sum(e <= row[k] for e in edge)]
        for i, j, table in model.pairs:
            total += table[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    texts = ["The cat, the dog!\nThe cat", "", "12 | 34\n\n12 | 34", "Ünïcode wörds evermore"]
    raw = [t.encode() for t in texts]
    made = gam.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    col = {n: k for k, n in enumerate(gam.NAMES)}
    for t, b, row in zip(texts, raw, made):
        words, lines = b.split(), [x for x in b.split(b"\n") if x]
        n, m = max(1, len(b)), max(1, len(words))
        assert math.isclose(row[col["log_bytes"]], math.log1p(len(b)))
        assert math.isclose(row[col["upper"]], sum(65 <= c <= 90 for c in b) / n) and math.isclose(row[col["digits"]], sum(48 <= c <= 57 for c in b) / n)
        assert math.isclose(row[col["non_ascii"]], sum(c >= 128 for c in b) / n) and math.isclose(row[col["bars"]], b.count(b"|") / n)
        assert math.isclose(row[col["distinct_words"]], len({w.lower() for w in words}) / m) and math.isclose(row[col["word_bytes"]], sum(map(len, words)) / m)
        assert math.isclose(row[col["distinct_lines"]], len({x.lower() for x in lines}) / max(1, len(lines))) and math.isclose(row[col["words_per_line"]], len(words) / max(1, len(lines)))
        assert math.isclose(row[col["short_words"]], sum(len(w) <= 3 for w in words) / m) and math.isclose(row[col["long_words"]], sum(len(w) >= 12 for w in words) / m)


def test_training_ignores_repeated_copies(spark):
    docs = _frame(spark, ["good words here"] * 30 + ["bad ! bad"], [2] * 30 + [0])
    marks = spark.createDataFrame([(2, 1), (0, 0)], "doc_id long, quality int")
    once = gam.train(docs.dropDuplicates(["doc_id"]), marks)
    assert gam.train(docs, marks).bias == once.bias


# --- 9 ------------------------------------------------------------------------------------------------


def test_chat(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|im_start|>", "", "a\nb", "<|", "\\n"]
    turns = [("user", tricky[0]), ("assistant", tricky[1]), ("ro\nle\\", tricky[2]), ("assistant", tricky[3]), ("assistant", tricky[5]), ("user", tricky[4])]
    made = list(chat.examples(turns))
    assert len(made) == 4 and made[-1][1:] == (0, 0)
    assert chat.read_turns(made[-1][0]) == turns
    assert [chat.unescape(t[a:b]) for t, a, b in made[:3]] == [tricky[1], tricky[3], tricky[5]]
    for t in tricky:
        assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t)
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, None, None), (None, 0, "assistant", "x"), (None, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(frame).collect()}
    assert got[1].n_turns == 6 and got[1].loss_chars == sum(map(len, (tricky[1], tricky[3], tricky[5])))
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((tricky[1] + tricky[3] + tricky[5]).encode()).hexdigest()
    assert got[2].n_turns == 1 and got[None].loss_chars == 1
    assert chat.expand(frame).count() == 4 + 1 + 1
    assert chat.read_back(frame.limit(0)).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------


def _brute_secrets(text):
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_credentials_of_any_length():
    for user, word in (("u", "p" * 93), ("u" * 65, "p" * 3), ("u" * 300, "p" * 5000), ("u", "ppp")):
        url = f"https://{user}:{word}@"
        assert secret_ledger.find_spans(f"see {url}host/x") == [(4, "basic_auth", 4 + len(url))]
    assert secret_ledger.find_spans("https://u:pp@host https://host:8080/a@b") == []


def test_secrets(spark, odd, tmp_path):
    texts = ["é password = 'hunter22hunter' x", "paſſword: abcdefghij", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "ab" * 16 + "g" + "0" * 31, "Api_Key:\"" + "z" * 8, "secret=short", None, "", "token=token=abcdefgh1"]
    got = {r.doc_id: r for r in secret_ledger.digest(secret_ledger.findings(_frame(spark, texts))).collect()}
    for n, t in enumerate(texts):
        want = _brute_secrets(t or "")
        joined = ",".join(f"{secret_ledger.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert got[n].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert (got[n].n_assign, got[n].n_access, got[n].n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
    ledger = str(tmp_path / "ledger")
    first = secret_ledger.update_ledger(_frame(spark, texts), ledger).count()
    assert first == len({t or "" for t in texts})
    assert secret_ledger.update_ledger(_frame(spark, [*texts, "new"]), ledger).count() == first + 1
    assert secret_ledger.update_ledger(_frame(spark, texts), ledger, "2").count() == 2 * first + 1
    assert secret_ledger.findings(odd).count() == odd.count()
    assert secret_ledger.findings(odd.limit(0)).count() == 0
