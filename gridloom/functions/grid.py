"""Column expressions of odd-level grids. Rounding is half to even throughout (``rint``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: plans write a column's expression out wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def digit(w: Column, m: Column, k: int) -> Column:
    """The digit of ``w`` on the k-level grid of scale ``m``; a zero scale gives digit 0."""
    half = (k - 1) // 2
    return clamp(F.rint((w + m) * (F.lit(float(half)) / F.greatest(m, F.lit(1e-30)))), 0.0, float(k - 1)).cast("int")


def digit_by_step(w: Column, m: Column, k: int) -> Column:
    """The same grid, dividing by the step 2m/(k-1)."""
    step = 2.0 * m / (k - 1)
    return F.when(m == 0, 0).otherwise(clamp(F.rint((w + m) / step), 0.0, float(k - 1)).cast("int"))


def dequantize(d: Column, m: Column, k: int) -> Column:
    half = (k - 1) // 2
    return m * (d - half) / F.lit(float(half))


def signed_code(w: Column, m: Column, top: int) -> Column:
    """Symmetric integer code in [-top, top] of scale m/top."""
    return F.when(m == 0, 0).otherwise(clamp(F.rint(w / (m / top)), float(-top), float(top)).cast("int"))


def ternary(w: Column, gamma: Column) -> Column:
    """1, 0 or -1; the thresholds of half of gamma are strict."""
    return F.when(w > 0.5 * gamma, 1).when(w < -0.5 * gamma, -1).otherwise(0)


def nine_step_code(w: Column, m: Column) -> Column:
    """Codes -4..4 of the nine-step grid, whose scale is 9m/4."""
    return F.when(m == 0, 0).otherwise(clamp(F.rint(9.0 * w / (9.0 * m / 4.0)), -4.0, 4.0).cast("int"))


def affine_digit(w: Column, low: Column, high: Column, k: int) -> Column:
    step = F.greatest((high - low) / (k - 1), F.lit(1e-12))
    return clamp(F.rint((w - low) / step), 0.0, float(k - 1)).cast("int")


def affine_value(d: Column, low: Column, high: Column, k: int) -> Column:
    return low + d * F.greatest((high - low) / (k - 1), F.lit(1e-12))


def log_scale_code(m: Column, low: Column, high: Column) -> Column:
    """8-bit code of log2 m between low and high; values under 1e-30 count as 1e-30."""
    return clamp(F.rint((F.log2(F.greatest(m, F.lit(1e-30))) - low) / (high - low) * 255.0), 0.0, 255.0).cast("int")


def log_scale_value(q: Column, low: Column, high: Column) -> Column:
    return F.pow(F.lit(2.0), low + q / 255.0 * (high - low))


def to_linear(c: Column) -> Column:
    """sRGB in [0, 1] to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def to_srgb8(x: Column) -> Column:
    """Linear light to 8-bit sRGB."""
    y = clamp(x, 0.0, 1.0)
    return F.rint(255.0 * F.when(y <= 0.0031308, y * 12.92).otherwise(1.055 * F.pow(y, F.lit(1 / 2.4)) - 0.055)).cast("int")


def lanes(size: Column, rows: Column, want: int) -> Column:
    """The number of lanes: one for each 2 MiB begun, at most ``want`` and the rows, at least 1."""
    return F.greatest(F.lit(1), F.least(F.lit(want), F.ceil(size / float(1 << 21)), rows)).cast("long")


def native_type(k: Column) -> Column:
    """The block type that holds k levels; even or out-of-range k is an error."""
    bad = F.raise_error(F.concat(F.lit("no block type holds k="), k.cast("string"))).cast("string")
    return F.when((k % 2 == 0) | (k < 3) | (k > 99), bad).when(k <= 15, "b4").when(k <= 63, "b6").otherwise("b7")


def planned_levels(rank: Column, inner: Column, elements: Column, is_table: Column, body: int = 63, aux: int = 99) -> Column:
    """Levels for a tensor; null (copied as it is) for vectors, odd widths and small tensors."""
    copied = (rank < 2) | (inner % 64 != 0) | (elements < 1_000_000)
    return F.when(copied, F.lit(None).cast("int")).when(is_table, aux).otherwise(body)


def psnr(mse: Column, peak: float = 1.0) -> Column:
    """Decibels; infinite without error."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(F.lit(peak * peak) / mse))


def warmup_cosine(step: Column, warm: int, total: int, peak: float) -> Column:
    """A learning rate that rises linearly for ``warm`` steps and falls as a cosine to ``total``."""
    part = (step - warm) / float(max(1, total - warm))
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * F.least(part, F.lit(1.0)))))


def xorshift16(x: Column) -> Column:
    """One step of the 16-bit xorshift register (shifts 7, 9, 8)."""
    a = x.bitwiseXOR(F.shiftleft(x, 7).bitwiseAND(F.lit(0xFFFF)))
    b = a.bitwiseXOR(F.shiftright(a, 9))
    return b.bitwiseXOR(F.shiftleft(b, 8).bitwiseAND(F.lit(0xFFFF)))


def nearest(x: Column, table: list[float]) -> Column:
    """The index of the nearest table value; the first of equally near ones."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - v).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(table)]))
    return best["i"]


def half_rounded(x: Column) -> Column:
    """The nearest half-precision number (ties to even), as a double; beyond 65504 infinite."""
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-30)))), F.lit(-14)) - 10)
    near = F.rint(size / step) * step
    return F.signum(x) * F.when(near > 65504.0, F.lit(float("inf"))).otherwise(near)


def cell(x: Column, bounds: list[float]) -> Column:
    """How many of the rising ``bounds`` lie below ``x``."""
    return sum((F.when(x > b, 1).otherwise(0) for b in bounds), F.lit(0))
