"""Language identification by Bayesian evidence fusion (operator 1).

log P(lang | evidence) = log prior(lang | host, address suffix)
                         + log P(text | lang) + log P(declared language | lang)

* Text: byte trigram likelihoods of lower-cased text, hashed to ``BUCKETS`` cells,
  learnt by grouped counts from about ``sample`` rows of each declared language
  (the first by hash, to the end of a slot of hashes: the documented bound of the
  fit) and tempered, as the trigrams of a text are not independent.
* Declared language (the ``lang`` of a page's markup, or of a document) is a noisy
  observation: a confusion table, counted over all rows against the text's own
  verdict and smoothed. Tags are compared by their first part in lower case
  (``en-US`` is ``en``); every language declared is kept.
* Host prior: counts of text verdicts by host, smoothed towards those of the
  address suffix, which are smoothed towards those of the corpus. All three are
  grouped aggregations over all rows; hosts are joined back by a shuffle, never
  broadcast, so a hot host is split.

A text in none of the languages is one more hypothesis: even trigrams, and a
prior of ``NO_LANGUAGE``. A row is accepted when it has letters and its best
language has a posterior of ``least`` or more.

Defined cases: null or letterless texts are rejected (their language is the best
by the other evidence); null or unknown declarations, addresses and hosts are no
evidence; with no declared language at all there is nothing to learn: language
null, rejected; repeated rows are judged each on its own; of equally likely languages
the first by name is taken; a text of any length is read whole; an empty table gives
no rows; columns beside the five that are named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import scratch, textbytes

BUCKETS, SAMPLE, TEMPER, NO_LANGUAGE = 1 << 15, 20_000, 0.1, 0.01
_HELD = 64  # languages a worker counts before it sends them on
_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOW[~_LETTER] = 32  # digits and punctuation are all one gap


def _cells(data: np.ndarray, offs: np.ndarray):
    """Trigram cells of each position, the row of each, and whether it counts (inside a row, around a letter)."""
    low = _LOW[data]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    cell = ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(17)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    good = (row[:-2] == row[2:]) & _LETTER[data[1:-1]]
    return cell, row[:-2], good


def _count_cells(batches):
    """(lang, cell, c): counts of the rows of a partition, sent on whenever ``_HELD`` languages are held."""
    total: dict[str, np.ndarray] = {}

    def sent():
        for lang, t in total.items():
            cell = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(t[cell], pa.int64())], names=["lang", "cell", "c"])
        total.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for r0, _, data, offs in textbytes.blocks(batch.column(1)):
            cell, row, good = _cells(data, offs)
            for k in range(len(offs) - 1):
                lang = langs[r0 + k]
                if lang not in total and len(total) == _HELD:
                    yield from sent()
                a, b = int(offs[k]), min(int(offs[k + 1]), len(cell))
                got = np.bincount(cell[a:b][good[a:b]], minlength=BUCKETS)
                total[lang] = total[lang] + got if lang in total else got
    yield from sent()


def tag_of(lang: Column) -> Column:
    """The language of a declared tag: its first part in lower case; tags that start with a single letter stay whole."""
    tag = F.lower(F.trim(F.translate(lang, "_", "-")))
    first = F.substring_index(tag, "-", 1)
    return F.nullif(F.when(F.length(first) == 1, tag).otherwise(first), F.lit(""))


def fit_text(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages declared in ``docs(lang, text)`` and log P(cell | lang), languages by cells."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    chosen = labelled.withColumn("_slot", F.shiftright(F.xxhash64("text"), 48))
    # a bounded, hash-ordered sample of each language: the slots of the hashes are counted, then the rows up to the bound are read
    before = Window.partitionBy("lang").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = chosen.groupBy("lang", "_slot").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    bounds = slots.where(F.col("_before") < sample).groupBy("lang").agg(F.max("_slot").alias("_bound"))
    taken = chosen.join(F.broadcast(bounds), "lang").where("_slot <= _bound").select("lang", "text")
    cells = taken.mapInArrow(textbytes.lean(_count_cells), "lang string, cell int, c long").groupBy("lang", "cell").agg(F.sum("c").alias("c"))
    packed = cells.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("c").alias("cs")).toArrow().sort_by("lang")
    names = packed["lang"].to_pylist()
    table = np.ones((len(names), BUCKETS)) * 0.5
    for k in range(len(names)):
        table[k, packed["cells"][k].values.to_numpy()] += packed["cs"][k].values.to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def _score_rows(table: np.ndarray, temper: float, text_at: int):
    """Adds ``ll``, ``none`` (tempered log-likelihoods of the text in each language and in none) and ``letters``."""
    cells_first, k = np.ascontiguousarray(table.T.astype(np.float32)), len(table)

    def run(batches):
        for batch in batches:
            for r0, r1, data, offs in textbytes.blocks(batch.column(text_at)):
                n = len(offs) - 1
                cell, row, good = _cells(data, offs)
                cell, row = cell[good], row[good]
                ll = np.zeros((n, k))
                for j in range(k):
                    ll[:, j] = np.bincount(row, weights=cells_first[cell, j], minlength=n)
                ll *= temper
                letters = np.add.reduceat(np.concatenate((_LETTER[data], [False])).astype(np.int64), np.minimum(offs[:-1], len(data))) * (np.diff(offs) > 0)
                none = temper * np.log(1.0 / BUCKETS) * np.bincount(row, minlength=n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(ll.reshape(-1)))
                part = batch.slice(r0, r1 - r0)
                kept = [c for i, c in enumerate(part.columns) if i != text_at]
                names = [c for i, c in enumerate(part.schema.names) if i != text_at]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(none), pa.array(letters, pa.int64())], names=[*names, "ll", "none", "letters"])

    return run


def suffix_of(host: Column) -> Column:
    """The last label of a host's name, where it has more than one."""
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1)))


def identify(rows: DataFrame, least: float = 0.5, sample: int = SAMPLE, temper: float = TEMPER) -> DataFrame:
    """(id, language, posterior, accepted) for each row of ``rows(id, text, lang, host, suffix)``.

    ``lang`` is the declared language; ``host`` and ``suffix`` may be null.
    """
    rows = rows.withColumn("lang", tag_of(F.col("lang")))
    names, table = fit_text(rows, sample)
    if not names:
        return rows.select("id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    own = rows.select("id", "lang", "host", "suffix", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    scored = own.mapInArrow(textbytes.lean(_score_rows(table, temper, 4)), f"{kinds}, ll array<double>, none double, letters long")
    scored = scratch.keep(scored.withColumn("said", F.when(F.col("letters") > 0, F.array_position("ll", F.array_max("ll")).cast("int") - 1)), "langid")
    k = len(names)

    counts = scored.where("said is not null").groupBy("host", "suffix", "lang", "said").count()
    counts = scratch.keep(counts, "langid-counts")

    def spread(keys: list[str]) -> DataFrame:
        each = [F.sum(F.when(F.col("said") == j, F.col("count")).otherwise(0)).cast("double") for j in range(k)]
        return counts.groupBy(*keys).agg(F.array(*each).alias("n"))

    whole = spread([]).first().n
    whole = [0.0 if x is None else x for x in whole] if whole else [0.0] * k
    corpus = [(x + 1.0) / (sum(whole) + k) for x in whole]
    flat = F.array(*[F.lit(p) for p in corpus])

    def smoothed(n: str, prior: str, strength: float) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, prior, lambda x, p: (x + strength * p) / (total + strength))

    by_suffix = spread(["suffix"]).where("suffix is not null").withColumn("p", flat).select(F.col("suffix"), smoothed("n", "p", 10.0).alias("ps"))
    by_host = spread(["host", "suffix"]).where("host is not null").join(by_suffix, "suffix", "left").withColumn("ps", F.coalesce("ps", flat))
    by_host = by_host.select(F.col("host").alias("_host"), F.col("suffix").alias("_s"), smoothed("n", "ps", 5.0).alias("ph"))

    def evidence(key: str) -> DataFrame:
        """log P(value | lang) up to a term that all languages share: the value's smoothed share of each language's rows."""
        n = spread([key]).where(F.col(key).isNotNull())
        share = F.zip_with("n", F.array(*[F.lit(float(x)) for x in whole]), lambda a, t: F.log((a + 0.5) / (t + 1.0)))
        return n.select(key, share.alias(f"e_{key}"))

    zero = F.array(*[F.lit(0.0)] * k)
    fused = scored.join(by_host, (F.col("host") == F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_s")), "left").drop("_host", "_s")
    fused = fused.join(evidence("lang"), "lang", "left").join(by_suffix, "suffix", "left")
    prior = F.transform(F.coalesce("ph", "ps", flat), lambda p: F.log(p))
    score = F.zip_with(F.zip_with("ll", prior, lambda a, b: a + b), F.coalesce("e_lang", zero), lambda a, b: a + b)
    fused = fused.withColumn("score", score).withColumn("top", F.array_max("score"))
    nowhere = F.exp(F.least(F.col("none") + F.lit(float(np.log(NO_LANGUAGE))) - F.col("top"), F.lit(700.0)))
    posterior = 1.0 / (F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))) + nowhere)
    language = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("score", F.col("top")).cast("int"))
    return fused.select("id", language.alias("language"), posterior.alias("posterior"), ((F.col("letters") > 0) & (posterior >= least)).alias("accepted"))
