"""Coded sizes of digit streams and scales, and the allocation of levels under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import stats

# Bytes of one scale in each mode.
SCALE_BYTES = {"fp32": 4.0, "fp16": 2.0, "int8": 1.0, "int6": 0.75}


def _parts(digits: DataFrame) -> DataFrame:
    """(tensor, n, h, scales): digits, their entropy, and how many (row, group) scales there are."""
    e = stats.entropy(stats.histogram(digits, ["tensor"], "d"), ["tensor"])
    s = digits.groupBy("tensor", "row", F.floor(F.col("col") / 64)).agg(F.first("m")).groupBy("tensor").agg(F.count("*").alias("scales"))
    return e.join(s, "tensor")


def tensor_cost(digits: DataFrame, k: int, scale_bytes: float = 4.0) -> DataFrame:
    return _parts(digits).select("tensor", (F.col("h") * F.col("n") / 8.0 + F.col("scales") * scale_bytes + 2 * k).alias("bytes"))


def by_scale_mode(digits: DataFrame, k: int) -> DataFrame:
    """(tensor, mode, bytes): one row for each way to store the scales (an unpivot)."""
    modes = F.explode(F.create_map(*[F.lit(x) for kv in SCALE_BYTES.items() for x in kv])).alias("mode", "b")
    return _parts(digits).select("tensor", "n", "h", "scales", modes).select("tensor", "mode", (F.col("h") * F.col("n") / 8.0 + F.col("scales") * F.col("b") + 2 * k).alias("bytes"))


def digit_bytes(digits: DataFrame, k: int) -> DataFrame:
    """Bytes with a frequency table for each tensor, with one for all, and of the tables."""
    h = stats.histogram(digits, ["tensor"], "d")
    each = stats.entropy(h, ["tensor"]).agg(F.sum(F.col("h") * F.col("n") / 8.0).alias("per_tensor"), (F.count("*") * k * 2).alias("tables"))
    whole = stats.entropy(h.groupBy("d").agg(F.sum("n").alias("n")), []).select((F.col("h") * F.col("n") / 8.0).alias("together"))
    return each.crossJoin(whole)


def matched(windows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each variant of one family beside the largest of the other family that takes no more bytes.

    ``sizes(family, variant, bytes)`` has a row a variant; ``windows(family, variant, window, x)``
    has what was measured. Gives (variant, against, n, delta, se): the mean and standard error of
    the paired differences, family 'a' less family 'b'. Only the few sizes meet by range.
    """
    a = sizes.where("family = 'a'").select("variant", "bytes")
    b = sizes.where("family = 'b'").select(F.col("variant").alias("against"), F.col("bytes").alias("bb"))
    best = a.join(b, F.col("bb") <= F.col("bytes")).groupBy("variant").agg(F.max(F.struct("bb", "against"))["against"].alias("against"))
    left = windows.where("family = 'a'").select("variant", "window", "x").join(best, "variant")
    right = windows.where("family = 'b'").select(F.col("variant").alias("against"), "window", F.col("x").alias("y"))
    d = left.join(right, ["against", "window"]).withColumn("d", F.col("x") - F.col("y"))
    return d.groupBy("variant", "against").agg(F.count("*").alias("n"), F.avg("d").alias("delta"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))


def model_bytes(parts: DataFrame) -> DataFrame:
    """(body, embed, rest, total) bytes of ``parts(part, n, bits, scales)``: coded digits and 4-byte scales; 'rest' stays in single precision."""
    coded = F.when(F.col("part") == "rest", F.col("n") * 4.0).otherwise(F.col("n") * F.col("bits") / 8.0 + F.col("scales") * 4.0)
    each = [F.sum(F.when(F.col("part") == p, coded).otherwise(0.0)).alias(p) for p in ("body", "embed", "rest")]
    return parts.agg(*each).withColumn("total", F.col("body") + F.col("embed") + F.col("rest"))


def interpolated(x: Column, points: Column) -> Column:
    """y at ``x`` on the broken line through ``points``, an array of (x, y) in rising order; its ends go on level."""
    below = F.filter(points, lambda p: p["x"] <= x)
    above = F.filter(points, lambda p: p["x"] > x)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    return F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) / (b["x"] - a["x"]) * (x - a["x"]))


def allocate(options: DataFrame, budget: float, start: int) -> dict[str, int]:
    """Levels for each tensor from (tensor, k, bytes, err): the affordable upgrade that saves most error a byte, again and again.

    The table has a row for each tensor and level, so it is gathered on the driver.
    Among equal savings the later name, then the higher level goes first.
    """
    rows = {(r.tensor, r.k): (r.bytes, r.err) for r in options.select("tensor", "k", "bytes", "err").toLocalIterator()}
    levels = {t: start for t, k in rows if k == start}
    spent = sum(rows[t, k][0] for t, k in levels.items())
    while True:
        best = None
        for (t, k), (size, err) in rows.items():
            if t in levels and k > levels[t]:
                more, less = size - rows[t, levels[t]][0], rows[t, levels[t]][1] - err
                if more > 0 and less > 0 and spent + more <= budget:
                    key = (less / more, t, k)
                    if best is None or key > best[0]:
                        best = (key, more)
        if best is None:
            return levels
        (_, t, k), more = best
        levels[t] = k
        spent += more
