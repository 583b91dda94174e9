"""Entropy, match rates, errors and paired statistics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(cells: DataFrame, keys: list[str], symbol: str, levels: int | None = None) -> DataFrame:
    """Counts of each symbol; with ``levels`` the absent ones of 0..levels-1 count 0."""
    counts = cells.groupBy(*keys, symbol).agg(F.count("*").alias("n"))
    if levels is None:
        return counts
    names = counts.select(*keys).distinct() if keys else counts.limit(1).select()
    domain = names.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias(symbol))
    return domain.join(counts, [*keys, symbol], "left").select(*keys, symbol, F.coalesce("n", F.lit(0)).alias("n"))


def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, h): order-0 entropy in bits of counts ``n``; sums only, no second look at the cells."""
    total, weighted = F.sum("n"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2(F.col("n").cast("double"))).otherwise(0.0))
    return counts.groupBy(*keys).agg(total.alias("n"), (F.log2(total.cast("double")) - weighted / total).alias("h"))


def markov(rows: DataFrame, levels: int) -> DataFrame:
    """(tensor, h1): entropy of a digit given the one to its left in ``rows(tensor, d)``, all levels x levels cells counted once more.

    Neighbours are paired within the row's array; only counts are shuffled.
    """
    left, right = F.slice("d", 1, F.greatest(F.size("d") - 1, F.lit(0))), F.slice("d", 2, F.size("d"))
    each = rows.select("tensor", F.explode(F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x"))
    pairs = each.groupBy("tensor", "x.a", "x.b").agg(F.count("*").alias("n"))
    square = rows.select("tensor").distinct().select("tensor", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("a"))
    square = square.select("tensor", "a", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("b"))
    full = square.join(pairs, ["tensor", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    by_left = full.groupBy("tensor", "a").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    sums = by_left.groupBy("tensor").agg(F.sum("t").alias("t"), F.sum(F.col("t") * F.log2(F.col("t").cast("double")) - F.col("s")).alias("s"))
    return sums.select("tensor", (F.col("s") / F.col("t")).alias("h1"))


def lag_match(rows: DataFrame, lags: list[int]) -> DataFrame:
    """(tensor, lag, rate): how often a digit of ``rows(tensor, d)`` equals that ``lag`` columns before; 0 where rows are shorter."""

    def hits(n: int) -> Column:
        same = F.zip_with(F.slice("d", 1, F.greatest(F.size("d") - n, F.lit(0))), F.slice("d", n + 1, F.size("d")), lambda a, b: (a == b).cast("int"))
        return F.aggregate(same, F.lit(0).cast("long"), lambda s, x: s + x)

    each = [e for n in lags for e in (F.sum(hits(n)).alias(f"h{n}"), F.sum(F.greatest(F.size("d") - n, F.lit(0))).alias(f"n{n}"))]
    sums = rows.groupBy("tensor").agg(*each)
    rate = lambda n: F.when(F.col(f"n{n}") > 0, F.col(f"h{n}") / F.col(f"n{n}")).otherwise(0.0)
    return sums.select("tensor", F.explode(F.array(*[F.struct(F.lit(n).alias("lag"), rate(n).alias("rate")) for n in lags])).alias("x")).select("tensor", "x.lag", "x.rate")


def shuffled_match(cells: DataFrame, key: Column, value: str = "d") -> DataFrame:
    """(tensor, rate): how often neighbours are equal when a tensor's cells are put in the order of a hexadecimal ``key``.

    Cells are sorted within ranges of keys; where a range ends, its last cell meets the
    first of the next range that holds any, which takes a row a range.
    """
    keyed = cells.select("tensor", key.alias("_k"), F.col(value).alias("_v")).withColumn("_r", F.conv(F.substring("_k", 1, 4), 16, 10).cast("int"))
    before = F.lag("_v").over(Window.partitionBy("tensor", "_r").orderBy("_k"))
    inner = keyed.withColumn("_p", before).where("_p is not null").groupBy("tensor").agg(F.count_if(F.col("_p") == F.col("_v")).alias("h"), F.count("*").alias("n"))
    ends = keyed.groupBy("tensor", "_r").agg(F.min(F.struct("_k", "_v"))["_v"].alias("first"), F.max(F.struct("_k", "_v"))["_v"].alias("last"))
    edges = ends.withColumn("_p", F.lag("last").over(Window.partitionBy("tensor").orderBy("_r"))).where("_p is not null")
    edges = edges.groupBy("tensor").agg(F.count_if(F.col("_p") == F.col("first")).alias("h"), F.count("*").alias("n"))
    return inner.unionByName(edges).groupBy("tensor").agg((F.sum("h") / F.sum("n")).alias("rate"))


def row_match(cells: DataFrame) -> DataFrame:
    """(tensor, rate): how often a digit equals the one below it (the next row of the tensor)."""
    order = Window.partitionBy("tensor", "col").orderBy("row")
    below = cells.withColumn("b", F.lead("d").over(order)).where("b is not null")
    return below.groupBy("tensor").agg(F.avg((F.col("b") == F.col("d")).cast("double")).alias("rate"))


def mean_and_error(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, se): the standard error has n - 1 degrees of freedom."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("se"))


def paired_delta(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Mean and standard error of a - b over the keys that both have."""
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    return mean_and_error(both.withColumn("d", F.col("_a") - F.col("_b")), [], "d")


def relative_error(cells: DataFrame, keys: list[str], w: str, q: Column) -> DataFrame:
    """mean((w - q)^2) / population variance of w."""
    return cells.groupBy(*keys).agg((F.avg(F.pow(F.col(w) - q, F.lit(2.0))) / F.var_pop(w)).alias("rel_mse"))


def perplexity(rows: DataFrame, keys: list[str], nll: str, n: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.exp(F.sum(nll) / F.sum(n)).alias("ppl"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, p..): the value at rank int(n q) of the ascending order, by position, exact at any size."""
    order = Window.partitionBy(*keys).orderBy(value)
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    both = upto.join(total, keys) if keys else upto.crossJoin(F.broadcast(total))
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))), F.col(value))).alias(f"p{round(q * 100)}") for q in shares]
    return both.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def robust_line(points: DataFrame, x: str, y: str, noise: float, passes: int = 2, limit: float = 5.0) -> DataFrame:
    """(slope, intercept, kept): least squares with points beyond ``limit`` standard residuals left out, refitted."""
    kept, fit = points, None
    for step in range(passes):
        fit = kept.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("kept"))
        if step + 1 < passes:
            residual = kept.crossJoin(F.broadcast(fit)).withColumn("_r", F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x)))
            spread = residual.agg(F.greatest(F.stddev_pop("_r"), F.lit(noise)).alias("_s"))
            kept = residual.crossJoin(F.broadcast(spread)).where(F.abs("_r") < limit * F.col("_s")).select(points.columns)
    return fit
