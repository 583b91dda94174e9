"""A hidden Markov language model over word classes (operator 7).

Tokens are lower-case words and one end a text. The ``OWN`` most frequent tokens
are classes of their own; all others fall in one of ``SUFFIXES`` classes by a
hash of their last two bytes. A hidden Markov model with ``STATES`` states emits
classes, and a class emits its words in proportion to their smoothed counts, so

  log10 P(text) = log10 P_hmm(classes) + sum over tokens of log10(base(w) / base(class of w))

with base(w) = (c + 1) / (N + V + 1), which is also the baseline that is reported.

Counts are exact, over all training documents: words are hashed to 64 bits,
counted by partition, and summed in a shuffle. The most frequent ``TABLE`` counts
are broadcast (1 MB at most); the counts of all other words are joined to the
documents' distinct words by a shuffle on the word. Baum-Welch runs over the
whole class sequences of all training documents: long ones are cut into stretches
of ``STRETCH`` tokens to be worked abreast, whose ends meet exactly (see
:func:`_borders`); each partition sums its expected counts and a shuffle adds them
up. Scoring is the scaled forward recursion over each whole text, many texts abreast.

Defined cases: null text is empty (its only token is the end); null doc_id is
not held out; rows are kept apart by a row number, so repeats are scored each;
nothing to learn from gives uniform classes and counts of 0; of words with equal counts
those with smaller hashes are classes of their own; a text of any length is scored
whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import scratch, textbytes

STATES, OWN, SUFFIXES, TABLE, STRETCH, ROUNDS = 8, 1000, 512, 1 << 16, 256, 4
CLASSES = 1 + OWN + SUFFIXES
END = np.int64(-1)


def held_out_of(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _tokens(data, offs):
    """Word hashes, suffix classes, and per-row offsets of a block."""
    starts, ends, at = textbytes.word_spans(data, offs)
    h = textbytes.word_hashes(data, starts, ends).view(np.int64)
    if len(starts) == 0:
        return h, h.copy(), at
    last = textbytes._FOLD[data[ends - 1]]
    before = np.where(ends - starts > 1, textbytes._FOLD[data[np.maximum(ends - 2, 0)]], np.uint64(0))
    suffix = (textbytes.mix(last * np.uint64(257) + before) % np.uint64(SUFFIXES)).astype(np.int64) + 1 + OWN
    return h, suffix, at


def _count_words(batches):
    """(h, k, c): the words of a partition, their suffix class and count, combined every few blocks."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, ends = 0, 0

    def combined(parts):
        h, k, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, k, c = h[order], k[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], k[first], np.add.reduceat(c, first)

    def emit():
        h, k, c = combined(held)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(k.astype(np.int32)), pa.array(c)], names=["h", "k", "c"])

    for batch in batches:
        ends += len(batch)
        for _, _, data, offs in textbytes.blocks(batch.column(0)):
            h, suffix, _ = _tokens(data, offs)
            if len(h):
                held.append(combined([(h, suffix, np.ones(len(h), dtype=np.int64))]))
                size += len(held[-1][0])
            if size > 1_500_000:
                held[:] = [combined(held)]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield emit()
                    held.clear()
                    size = 0
    if held:
        yield emit()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([int(END)]), pa.array([0], pa.int32()), pa.array([ends])], names=["h", "k", "c"])


def _sequences(table):
    """Each row's class sequence, what the broadcast table settles of its sums, and its other distinct words."""

    def run(batches):
        hs, cs, ks, log_class, log_base = table.value
        for batch in batches:
            meta = batch.columns[:2]
            for r0, r1, data, offs in textbytes.blocks(batch.column(2)):
                h, suffix, at = _tokens(data, offs)
                n = len(offs) - 1
                row = np.repeat(np.arange(n), np.diff(at))
                spot = np.minimum(np.searchsorted(hs, h), max(len(hs) - 1, 0))
                known = hs[spot] == h if len(hs) else np.zeros(len(h), bool)
                cls = np.where(known & (ks[spot] > 0), ks[spot], suffix) if len(hs) else suffix
                settled = np.bincount(row, weights=np.where(known, log_base[spot], 0.0) if len(hs) else np.zeros(len(h)), minlength=n)
                n_known = np.bincount(row[known], minlength=n)
                own = np.bincount(row, weights=log_class[cls], minlength=n) + log_class[0]
                other, orow = h[~known], row[~known]
                order = np.lexsort((other, orow))
                other, orow = other[order], orow[order]
                new = np.concatenate(([True], (other[1:] != other[:-1]) | (orow[1:] != orow[:-1]))) if len(other) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                tf = np.diff(np.concatenate((first, [len(other)])))
                to = pa.array(np.concatenate(([0], np.cumsum(np.bincount(orow[first], minlength=n)))), pa.int32())
                with_end = np.insert(cls, at[1:], 0).astype("<u2")
                size = np.diff(at) + 1
                cut = np.concatenate(([0], np.cumsum(size)))
                seqs = [with_end[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(m.slice(r0, r1 - r0) for m in meta), pa.array(size, pa.int64()), pa.array(seqs, pa.binary()), pa.array(settled.astype(float)), pa.array(n_known, pa.int64()), pa.array(own.astype(float)), pa.ListArray.from_arrays(to, pa.array(other[first])), pa.ListArray.from_arrays(to, pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "held_out", "n_tokens", "seq", "settled", "n_known", "own", "words", "tf"],
                )

    return run


def _start() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    first = np.full(STATES, 1.0 / STATES)
    moves = rng.dirichlet(np.ones(STATES), STATES) * 0.3 + np.eye(STATES) * 0.7
    emits = rng.dirichlet(np.full(CLASSES, 0.5), STATES) * 0.5 + 0.5 / CLASSES
    return first, moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True)


def _borders(seqs, first, moves, by_class, stretch):
    """Each stretch's state probabilities before its first token (``entry``; of the token before it, ``prior``) and the backward vector after its last.

    A stretch is a linear map of state vectors. The maps of all stretches are made abreast,
    then each sequence chains its own in order, all sequences abreast.
    """
    parts = [seq[k : k + stretch] for seq in seqs for k in range(0, len(seq), stretch)]
    number = np.array([-(-len(seq) // stretch) for seq in seqs])
    begin = np.concatenate(([0], np.cumsum(number)[:-1]))
    states = len(first)
    entry, prior, after = (np.ones((len(parts), states), np.float32) for _ in range(3))
    entry[begin] = first
    inner = np.flatnonzero(np.repeat(number, number) > 1)
    if len(inner) == 0:
        return parts, begin, entry, prior, after
    order = inner[np.argsort([-len(parts[k]) for k in inner], kind="stable")]
    lens = np.array([len(parts[k]) for k in order])
    flat = np.concatenate([parts[k] for k in order])
    base = np.concatenate(([0], np.cumsum(lens)[:-1]))
    live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
    seen, ahead = np.ascontiguousarray(by_class.T), np.ascontiguousarray(moves.T)
    maps = np.eye(states, dtype=np.float32)[:, :, None] * seen[:, flat[base]]  # state before, state after, stretch
    for s in range(1, int(lens[0])):
        n = live[s]
        step = np.matmul(ahead, maps[:, :, :n])
        step *= seen[:, flat[base[:n] + s]]
        if s % 2:
            step /= step.sum((0, 1))
        if n == maps.shape[2]:
            maps = step
        else:
            maps[:, :, :n] = step
    maps = np.moveaxis(maps, 2, 0)
    place = np.empty(len(parts), dtype=np.int64)
    place[order] = np.arange(len(order))
    for j in range(1, int(number.max())):
        at = begin[number > j] + j
        out = np.einsum("di,dij->dj", entry[at - 1], maps[place[at - 1]])
        prior[at] = out / out.sum(1, keepdims=True)
        entry[at] = prior[at] @ moves
    for j in range(int(number.max()) - 1, 0, -1):
        at = begin[number > j] + j
        back = np.einsum("dij,dj->di", maps[place[at]], after[at]) @ moves.T
        after[at - 1] = back / back.sum(1, keepdims=True)
    return parts, begin, entry, prior, after


def _expect(model, stretch: int = STRETCH, room: int = 300_000):
    """Expected counts of a partition: (i, x), first, moves and emissions laid end to end."""

    def run(batches):
        first, moves, emits = (m.astype(np.float32) for m in model.value)
        by_class = np.ascontiguousarray(emits.T)
        states, classes = emits.shape
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))]

        def count(parts, starts, entry, prior, after):
            order = np.argsort([-len(p) for p in parts], kind="stable")
            lens = np.array([len(parts[k]) for k in order])
            starts, entry, prior, after = starts[order], entry[order], prior[order], after[order]
            d, t = len(order), int(lens[0])
            grid = np.zeros((t, d), dtype=np.int64)
            for j, k in enumerate(order):
                grid[: lens[j], j] = parts[k]
            live = np.searchsorted(-lens, -np.arange(1, t + 1), side="right")
            alphas, scales = np.empty((t, d, states), np.float32), np.ones((t, d), np.float32)
            for s in range(t):
                n = live[s]
                a = (alphas[s - 1, :n] @ moves if s else entry) * by_class[grid[s, :n]]
                scales[s, :n] = a.sum(1)
                alphas[s, :n] = a / scales[s, :n, None]
            beta = after / (alphas[lens - 1, np.arange(d)] * after).sum(1, keepdims=True)
            for s in range(t - 1, -1, -1):
                n = live[s]
                if s + 1 < t and live[s + 1]:
                    m = live[s + 1]
                    ahead = by_class[grid[s + 1, :m]] * beta[:m] / scales[s + 1, :m, None]
                    sums[1] += (alphas[s, :m].T @ ahead) * moves
                    beta[:m] = ahead @ moves.T
                if s:
                    alphas[s, :n] *= beta[:n]
            ahead = by_class[grid[0]] * beta / scales[0, :, None]
            sums[1] += (prior[~starts].T @ ahead[~starts]) * moves
            alphas[0] *= beta
            sums[0] += alphas[0, starts].sum(0)
            real = np.arange(t)[:, None] < lens[None, :]
            at, gamma = grid[real], alphas[real]
            for i in range(states):
                sums[2][:, i] += np.bincount(at, weights=gamma[:, i], minlength=classes)

        def learn(seqs):
            parts, begin, entry, prior, after = _borders(seqs, first, moves, by_class, stretch)
            starts = np.zeros(len(parts), dtype=bool)
            starts[begin] = True
            step = max(1, room // stretch)
            for k in range(0, len(parts), step):
                some = slice(k, k + step)
                count(parts[some], starts[some], entry[some], prior[some], after[some])

        held, size, seen = [], 0, False
        for batch in batches:
            for cell in batch.column(0):
                held.append(np.frombuffer(cell.as_py(), dtype="<u2"))
                size += len(held[-1])
                if size >= room:
                    learn(held)
                    held, size, seen = [], 0, True
        if held:
            learn(held)
            seen = True
        if seen:
            flat = np.concatenate([s.reshape(-1) for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "x"])

    return run


def train(seqs: DataFrame, rounds: int = ROUNDS):
    """First, transition and emission probabilities by Baum-Welch over ``seqs(seq)``."""
    model = _start()
    for _ in range(rounds):
        sent = seqs.sparkSession.sparkContext.broadcast(model)
        total = seqs.mapInArrow(textbytes.lean(_expect(sent)), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a fixed number of rows
        flat = np.zeros(STATES + STATES * STATES + CLASSES * STATES)
        for r in total:
            flat[r.i] = r.x
        first = flat[:STATES] + 0.1
        moves = flat[STATES : STATES + STATES**2].reshape(STATES, STATES) + 0.1
        emits = flat[STATES + STATES**2 :].reshape(CLASSES, STATES).T + 0.02
        model = tuple(m / m.sum(-1, keepdims=True) for m in (first, moves, emits))
        sent.unpersist()
    return model


def _forward(model):
    def run(batches):
        first, moves, emits = model.value
        by_class = np.ascontiguousarray(emits.T)

        def score(seqs):
            order = sorted(range(len(seqs)), key=lambda k: -len(seqs[k]))
            lens = np.array([len(seqs[k]) for k in order])
            flat = np.concatenate([seqs[k] for k in order])
            base = np.concatenate(([0], np.cumsum(lens)[:-1]))
            live = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
            alpha, out = np.broadcast_to(first, (len(order), STATES)), np.zeros(len(order))
            for s in range(int(lens[0])):
                n = live[s]
                alpha = (alpha[:n] @ moves if s else alpha) * by_class[flat[base[:n] + s]]
                scale = alpha.sum(1)
                out[:n] += np.log10(scale)
                alpha = alpha / scale[:, None]
            result = np.empty(len(order))
            result[order] = out
            return result

        for batch in batches:
            rids, seqs = batch.column(0), [np.frombuffer(c.as_py(), dtype="<u2") for c in batch.column(1)]
            begin, size = 0, 0
            for k in range(len(seqs)):
                size += len(seqs[k])
                if size >= 2_000_000 or k + 1 == len(seqs):
                    yield pa.RecordBatch.from_arrays([rids.slice(begin, k + 1 - begin), pa.array(score(seqs[begin : k + 1]))], names=["rid", "hmm"])
                    begin, size = k + 1, 0

    return run


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.where("not held_out").select("text").mapInArrow(textbytes.lean(_count_words), "h long, k int, c long")
    counts = scratch.keep(counts.groupBy("h").agg(F.min("k").alias("k"), F.sum("c").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    denominator = n + v + 1
    top = counts.where(F.col("h") != int(END)).orderBy(F.desc("c"), "h").limit(TABLE).collect()  # bounded by TABLE
    table = sorted((r.h, r.c, i + 1 if i < OWN else 0, r.k) for i, r in enumerate(top))
    mass = np.zeros(CLASSES)
    for r in counts.groupBy("k").agg(F.sum(F.col("c") + 1).alias("m")).collect():  # one row a class
        mass[r.k] += r.m
    for _, c, own, k in table:
        if own:
            mass[k] -= c + 1
            mass[own] += c + 1
    mass[1 + OWN :] += 1  # the unknown word of each suffix class
    mass = np.maximum(mass, 1.0)
    hs, cs, ks = (np.array([t[i] for t in table], dtype=np.int64) for i in range(3))
    log_base = np.log10((cs + 1.0) / denominator)
    sent = spark.sparkContext.broadcast((hs, cs, ks, np.log10(mass / denominator), log_base))
    kinds = "doc_id long, held_out boolean, n_tokens long, seq binary, settled double, n_known long, own double, words array<long>, tf array<int>"
    seqs = scratch.keep(rows.mapInArrow(textbytes.lean(_sequences(sent)), kinds).withColumn("rid", F.monotonically_increasing_id()), "sequences")

    model = spark.sparkContext.broadcast(train(seqs.where("not held_out").select("seq"), rounds))
    hmm = seqs.select("rid", "seq").mapInArrow(textbytes.lean(_forward(model)), "rid long, hmm double")
    rare = seqs.select("rid", F.explode(F.arrays_zip("words", "tf")).alias("w")).select("rid", F.col("w.words").alias("h"), F.col("w.tf").alias("tf"))
    met = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    lp = F.log10((F.col("c") + 1) / F.lit(float(denominator)))
    met = met.groupBy("rid").agg(F.sum(F.col("tf") * lp).alias("lp"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"))
    end_count = counts.where(F.col("h") == int(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    end = float(np.log10((end_count + 1.0) / denominator))
    out = seqs.select("rid", "doc_id", "held_out", "n_tokens", "settled", "n_known", "own").join(hmm, "rid").join(met, "rid", "left")
    base = F.col("settled") + F.coalesce("lp", F.lit(0.0)) + F.lit(end)
    known = F.col("n_known") + F.coalesce("more", F.lit(0)) + (1 if end_count else 0)
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + base - F.col("own")).alias("score"))
