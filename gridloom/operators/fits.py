"""Fitted grids and sequential quantisers. Rows are independent, so rows are the unit of parallel work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import half_rounded, let
from gridloom.operators import layout


def lloyd_max(values: np.ndarray, k: int, steps: int = 80) -> np.ndarray:
    """k centres that are the means of their cells; starts from an even grid, empty cells stay."""
    m = np.abs(values).max()
    centres = np.linspace(-m, m, k)
    for _ in range(steps):
        at = np.searchsorted((centres[1:] + centres[:-1]) / 2, values)
        n = np.bincount(at, minlength=k)
        new = np.where(n > 0, np.bincount(at, values, k) / np.maximum(n, 1), centres)
        moved = np.abs(new - centres).max()
        centres = new
        if moved < 1e-6 * (m + 1e-30):
            break
    return centres


def fitted_rows(wide: DataFrame, k: int) -> DataFrame:
    """(tensor, row, centres, d): a fitted grid for each group of a row."""

    def run(frames):
        for f in frames:
            centres = [lloyd_max(np.asarray(g), k) for g in f["g"]]
            d = [np.searchsorted((c[1:] + c[:-1]) / 2, np.asarray(g)).astype(np.int32) for c, g in zip(centres, f["g"])]
            yield pd.DataFrame({"tensor": f["tensor"], "row": f["row"], "grp": f["grp"], "centres": centres, "d": d})

    return layout.grouped(wide).mapInPandas(run, "tensor int, row long, grp int, centres array<double>, d array<int>")


def entropy_constrained(counts: np.ndarray, values: np.ndarray, k: int, weight: float, steps: int = 60) -> tuple[np.ndarray, float, float]:
    """Centres, mean square error and entropy of a quantiser of a weighted histogram that trades error for rate."""
    p = counts / counts.sum()
    centres, rate = np.linspace(values.min(), values.max(), k), np.full(k, np.log2(k))
    at = np.zeros(len(values), dtype=int)
    for _ in range(steps):
        at = np.argmin((values[:, None] - centres) ** 2 + weight * rate, axis=1)
        share = np.bincount(at, p, k)
        centres = np.where(share > 0, np.bincount(at, p * values, k) / np.maximum(share, 1e-300), centres)
        rate = np.where(share > 0, -np.log2(np.maximum(share, 1e-300)), 60.0)
    share = share[share > 0]
    return centres, float((p * (values - centres[at]) ** 2).sum()), float(-(share * np.log2(share)).sum())


def damped_inverse(h: np.ndarray, damp: float = 0.01, tries: int = 4) -> np.ndarray:
    """The upper Cholesky factor of the inverse of h plus a damped diagonal; damping grows tenfold where it fails."""
    for n in range(tries):
        try:
            inverse = np.linalg.inv(h + np.eye(len(h)) * damp * 10**n * max(float(np.mean(np.diag(h))), 1e-30))
            return np.linalg.cholesky(inverse).T
        except np.linalg.LinAlgError:
            continue
    raise ValueError("the matrix can't be made positive")


def compensated(wide: DataFrame, h: np.ndarray, k: int) -> DataFrame:
    """(tensor, row, d, q): columns are quantised in turn and each error is spread over the columns after it.

    Scales are those of the original groups. The factor (columns squared) is broadcast; rows need no shuffle.
    """
    factor = wide.sparkSession.sparkContext.broadcast(damped_inverse(h))

    def run(frames):
        u = factor.value
        for f in frames:
            w = np.array([np.asarray(v, dtype=np.float64) for v in f["v"]]).reshape(len(f), -1)
            n, c = w.shape
            m = np.abs(w.reshape(n, -1, min(layout.GROUP, c))).max(axis=2).repeat(min(layout.GROUP, c), axis=1) if n else w
            d, q = np.zeros((n, c), np.int32), np.zeros((n, c))
            for j in range(c):
                step = np.maximum(2 * m[:, j] / (k - 1), 1e-30)
                d[:, j] = np.clip(np.rint((w[:, j] + m[:, j]) / step), 0, k - 1)
                q[:, j] = d[:, j] * step - m[:, j]
                w[:, j + 1 :] -= ((w[:, j] - q[:, j]) / u[j, j])[:, None] * u[j, j + 1 :]
            yield pd.DataFrame({"tensor": f["tensor"], "row": f["row"], "d": list(d), "q": list(q)})

    return wide.select("tensor", "row", "v").mapInPandas(run, "tensor int, row long, d array<int>, q array<double>")


def gram_cells(wide: DataFrame) -> DataFrame:
    """(i, j, x): 2 X'X / n. Each partition multiplies its rows and sends one sum a cell."""

    def run(frames):
        total, n = None, 0
        for f in frames:
            if len(f):
                x = np.array([np.asarray(v, dtype=np.float64) for v in f["v"]])
                total, n = x.T @ x + (0 if total is None else total), n + len(x)
        if total is not None:
            i, j = np.divmod(np.arange(total.size), len(total))
            yield pd.DataFrame({"i": i, "j": j, "x": total.reshape(-1), "n": n})

    sums = wide.select("v").mapInPandas(run, "i int, j int, x double, n long").groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.select("i", "j", (2 * F.col("x") / F.col("n")).alias("x"))


def gram_matrix(wide: DataFrame) -> np.ndarray:
    """:func:`gram_cells` as one matrix on the driver, where its inverse is made: columns squared numbers, as Arrow."""
    cells = gram_cells(wide).toArrow()
    size = int(cells["i"].to_numpy().max()) + 1 if len(cells) else 0
    out = np.zeros((size, size))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["x"].to_numpy()
    return out


def with_feedback(wide: DataFrame, k: int, group: int = 64, feedback: float = 1.0) -> DataFrame:
    """(tensor, row, q): each group of a row on the k-level grid of its half-precision largest weight.

    A cell's target is its weight plus ``feedback`` times what the same place of the
    group before lost (weight less its value on the grid). A fold inside the row.
    """
    h = (k - 1) // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("v") / group).cast("int") - 1, F.lit(0)))
    empty = F.struct(F.expr("cast(array() as array<double>)").alias("q"), F.array_repeat(F.lit(0.0), group).alias("carry"))

    def one(s, own, m):
        target = F.zip_with(own, F.slice(s["carry"], 1, F.size(own)), lambda x, c: x + feedback * c)
        snapped = F.transform(target, lambda t: m * (F.least(F.greatest(F.rint(t / m * h + h), F.lit(0.0)), F.lit(k - 1.0)) - h) / h)
        return let(snapped, lambda q: F.struct(F.concat(s["q"], q).alias("q"), F.zip_with(own, q, lambda x, y: x - y).alias("carry")))

    def step(s, i):
        scale = lambda own: half_rounded(F.array_max(F.transform(own, lambda x: F.abs(x))))
        return let(F.slice("v", i * group + 1, group), lambda own: let(scale(own), lambda m: let(F.when(m == 0, 1.0).otherwise(m), lambda m: one(s, own, m))))

    return wide.select("tensor", "row", F.aggregate(starts, empty, step)["q"].alias("q"))


def leaky_fold(events: DataFrame, key: str, order: str, value: str, leak: float = 0.9, limit: float = 100.0) -> DataFrame:
    """(key, spikes, charge): a leaky sum in order that fires and starts again at its limit; an SQL fold over each key's values."""
    steps = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_x"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("v"))

    def step(s, x):
        v = s["v"] * leak + x[value]
        return F.struct((s["n"] + F.when(v >= limit, 1).otherwise(0)).alias("n"), F.when(v >= limit, 0.0).otherwise(v).alias("v"))

    return steps.withColumn("_s", F.aggregate("_x", zero, step)).select(key, F.col("_s.n").alias("spikes"), F.col("_s.v").alias("charge"))


def chained_sums(records: DataFrame, case: str, order: str, value: str) -> DataFrame:
    """(case, n, sums): single-precision running sums of each case in order, starting again with each case.

    Single-precision sums depend on their order, so a case is one fold.
    """
    steps = records.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("float")).alias("_x"))
    zero = F.struct(F.lit(0.0).cast("float").alias("s"), F.expr("cast(array() as array<float>)").alias("all"))

    def step(a, x):
        s = (a["s"] + x).cast("float")
        return F.struct(s.alias("s"), F.concat(a["all"], F.array(s)).alias("all"))

    return steps.select(case, F.size("_x").alias("n"), F.aggregate("_x", zero, step)["all"].alias("sums"))
