"""A quality classifier: generalised additive model with pairwise interactions (operator 8).

The score of a text is the logistic of a sum of table look-ups: one table for
each feature, over its bins, and one for each of a few pairs of features, over
coarse bins. Tables are learnt by cyclic boosting: round after round, each
feature in turn gets a shallow tree on the residual, which is added to its
table; then pairs are ranked by what a four-leaf tree on the residual gains and
the best are boosted in the same way. Scoring adds bins, by numpy, for a block
of texts at a time.

Features come from the text alone. The fit uses at most ``SAMPLE`` labelled rows,
those that come first by a hash of their id (the documented bound of the fit);
only the ids of that sample are broadcast, 160 kB.

Defined cases: null and empty texts have all features 0 and get a score like any
other; without labels, or with one class only, the score is the smoothed share
of label 1; null labels are ignored; null doc_id is not held out and has no
label; of rows that share a labelled doc_id one is learnt from, and all are scored;
a text of any length is scored whole; no documents give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textbytes

SAMPLE, BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 20_000, 32, 8, 60, 20, 6, 0.15
NAMES = ("log_bytes", "upper", "digits", "blanks", "punctuation", "symbols", "non_ascii", "word_bytes", "words_per_line", "distinct_words", "distinct_lines", "short_words", "long_words", "commonest_bytes", "sentence_ends", "bars")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256)
    table[list(chars)] = 1.0
    return table


_SHARES = {
    "upper": _class(bytes(range(65, 91))), "digits": _class(b"0123456789"), "blanks": _class(b" \t\r\n"), "punctuation": _class(b".,;:!?'\"()-"),
    "symbols": _class(b"#$%&*+/<=>@[\\]^_`{}~"), "non_ascii": _class(bytes(range(128, 256))), "sentence_ends": _class(b"!?"), "bars": _class(b"|"),
}


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows by ``NAMES`` for the rows of a block."""
    n = len(offs) - 1
    size = np.diff(offs)
    out = np.zeros((n, len(NAMES)))
    col = {name: k for k, name in enumerate(NAMES)}
    row = np.repeat(np.arange(n), size)
    some = np.maximum(size, 1)
    for name, table in _SHARES.items():
        out[:, col[name]] = np.bincount(row, weights=table[data], minlength=n) / some
    out[:, col["log_bytes"]] = np.log1p(size)
    starts, ends, at = textbytes.word_spans(data, offs)
    words = np.diff(at)
    wrow = np.repeat(np.arange(n), words)
    lens = ends - starts
    most = np.maximum(words, 1)
    out[:, col["word_bytes"]] = np.bincount(wrow, weights=lens, minlength=n) / most
    out[:, col["short_words"]] = np.bincount(wrow, weights=lens <= 3, minlength=n) / most
    out[:, col["long_words"]] = np.bincount(wrow, weights=lens >= 12, minlength=n) / most
    out[:, col["distinct_words"]] = _distinct(textbytes.word_hashes(data, starts, ends), wrow, n) / most
    is_line = np.ones(256, dtype=bool)
    is_line[10] = False
    ls, le, lat = textbytes.word_spans(data, offs, is_line)
    lines = np.diff(lat)
    lrow = np.repeat(np.arange(n), lines)
    out[:, col["distinct_lines"]] = _distinct(textbytes.word_hashes(data, ls, le), lrow, n) / np.maximum(lines, 1)
    out[:, col["words_per_line"]] = words / np.maximum(lines, 1)
    pair = np.bincount(row * 32 + (data & 31), minlength=n * 32).reshape(n, 32) if len(data) else np.zeros((n, 32))
    out[:, col["commonest_bytes"]] = np.sort(pair, axis=1)[:, -4:].sum(1) / some
    return out


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    if len(hashes) == 0:
        return np.zeros(n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    return np.bincount(r[new], minlength=n).astype(float)


class Additive:
    """Bin edges, one table for each feature, and tables for pairs."""

    def __init__(self, bias: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.bias, self.edges, self.tables, self.coarse, self.pairs = bias, edges, tables, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edge, x[:, k], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step values of a shallow tree over ordered bins with gradient and curvature sums."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = cg**2 / (ch + 1.0) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1.0)
    gain[(ch < 1.0) | (h.sum() - ch < 1.0)] = -1.0
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
        return out
    return np.concatenate((_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)))


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four-leaf cut of a pair's grid: its gain and step values."""
    best, step = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            cells = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            sums = [(g[c].sum(), h[c].sum()) for c in cells]
            gain = sum(a * a / (b + 1.0) for a, b in sums)
            if gain > best:
                best, step = gain, np.zeros_like(g)
                for c, (a, b) in zip(cells, sums):
                    step[c] = a / (b + 1.0)
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting on features ``x`` and labels ``y`` (0 or 1)."""
    k = x.shape[1] if x.ndim == 2 else len(NAMES)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(share / (1 - share)))
    none = [np.zeros(0)] * k
    if len(y) == 0 or y.min() == y.max():
        return Additive(bias, none, [np.zeros(1)] * k, none, [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, COARSE + 1)[1:-1])) for j in range(k)]
    bins = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(k)]
    wide = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), bias)

    def residual():
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = residual()
            step = RATE * _tree(np.bincount(bins[j], g, len(tables[j])), np.bincount(bins[j], h, len(tables[j])))
            tables[j] += step
            total += step[bins[j]]
    g, h = residual()

    def grid(i, j, w):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(wide[i] * shape[1] + wide[j], w, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((-_quarters(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(k) for j in range(i)))[:PAIRS]
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            g, h = residual()
            step = RATE * _quarters(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[wide[i], wide[j]]
    return Additive(bias, edges, tables, coarse, pairs)


def _feature_rows(batches):
    for batch in batches:
        for r0, r1, data, offs in textbytes.blocks(batch.column(1)):
            x = features(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), lists], names=["y", "x"])


def held_out_of(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """Fit on at most ``sample`` labelled rows of ``labels(doc_id, label)`` that are not held out."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out_of(F.col("doc_id")))
    chosen = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select(F.struct("doc_id", "y").alias("y"), "text")
    made = rows.mapInArrow(textbytes.lean(_feature_rows), "y struct<doc_id: bigint, y: int>, x array<double>")
    table = made.groupBy("y").agg(F.min("x").alias("x")).select("y.y", "x").toArrow()  # at most ``sample`` rows: of versions of a document one
    x = table.column("x").combine_chunks()
    flat = x.flatten().to_numpy() if len(x) else np.zeros(0)
    x, y = flat.reshape(-1, len(NAMES)), table.column("y").to_numpy().astype(float)
    order = np.lexsort(np.vstack((x.T, y)))
    return fit(x[order], y[order])


def score_texts(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for r0, r1, data, offs in textbytes.blocks(batch.column(2)):
                score = sent.value.score(features(data, offs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, r1 - r0), batch.column(1).slice(r0, r1 - r0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(textbytes.lean(run), "doc_id long, held_out boolean, score double, predicted int")
