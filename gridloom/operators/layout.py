"""Weight matrices as rows of arrays (wide) and as cells (long).

Wide rows keep a group's arithmetic inside one row: no shuffle. Long cells are
for grouped aggregates, which combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = 64


def weights(embeddings: DataFrame) -> DataFrame:
    """(tensor, row, v): vectors as rows of weight matrices, in double precision."""
    return embeddings.select(F.col("label").alias("tensor"), F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def grouped(wide: DataFrame, size: int = GROUP) -> DataFrame:
    """(tensor, row, grp, g): each row's consecutive groups of ``size`` columns."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("v") / size).cast("int") - 1, F.lit(0)))
    return wide.select("tensor", "row", "v", F.explode(starts).alias("grp")).select("tensor", "row", "grp", F.slice("v", F.col("grp") * size + 1, size).alias("g"))


def cells(wide: DataFrame) -> DataFrame:
    """(tensor, row, col, w)."""
    return wide.select("tensor", "row", F.posexplode("v").alias("col", "w"))


def absmax(v: str) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def mean_of(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def digits(wide: DataFrame, k: int) -> DataFrame:
    """(tensor, row, m, d): each group's scale and digit array, one group a row."""
    from gridloom.functions import grid

    g = grouped(wide).withColumn("m", absmax("g"))
    return g.select("tensor", "row", "grp", "m", "g", F.transform("g", lambda x: grid.digit(x, F.col("m"), k)).alias("d"))


def digit_rows(wide: DataFrame, k: int) -> DataFrame:
    """(tensor, row, d): the digits of whole rows, each group on its own scale."""
    from gridloom.functions import grid

    def of_group(i):
        g = F.slice("v", i * GROUP + 1, GROUP)
        return grid.let(F.array_max(F.transform(g, lambda x: F.abs(x))), lambda m: F.transform(g, lambda x: grid.digit(x, m, k)))

    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("v") / GROUP).cast("int") - 1, F.lit(0)))
    return wide.select("tensor", "row", F.flatten(F.transform(starts, of_group)).alias("d"))


def digit_cells(wide: DataFrame, k: int) -> DataFrame:
    """(tensor, row, col, w, m, d)."""
    d = digits(wide, k).select("tensor", "row", "grp", "m", F.posexplode(F.arrays_zip("g", "d")).alias("p", "x"))
    return d.select("tensor", "row", (F.col("grp") * GROUP + F.col("p")).alias("col"), F.col("x.g").alias("w"), "m", F.col("x.d").alias("d"))


def weighted_digits(wide: DataFrame, importance: DataFrame, k: int) -> DataFrame:
    """(tensor, row, grp, m, g, d) with the scale of each group taken from magnitudes times ``importance(tensor, imp)``.

    A tensor without importance, or with one of another width, is scaled as usual. The
    importance has a row a tensor and is joined by tensor.
    """
    from gridloom.functions import grid

    own = wide.join(importance.select("tensor", "imp"), "tensor", "left").withColumn("imp", F.when(F.size("imp") == F.size("v"), F.col("imp")))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("v") / GROUP).cast("int") - 1, F.lit(0)))
    g = own.select("tensor", "row", "v", "imp", F.explode(starts).alias("grp"))
    cut = lambda c: F.slice(c, F.col("grp") * GROUP + 1, GROUP)
    g = g.select("tensor", "row", "grp", cut("v").alias("g"), cut("imp").alias("i"))
    m = F.array_max(F.when(F.col("i").isNull(), F.transform("g", lambda x: F.abs(x))).otherwise(F.zip_with("g", "i", lambda x, i: F.abs(x) * i)))
    return g.withColumn("m", m).select("tensor", "row", "grp", "m", "g", F.transform("g", lambda x: grid.digit(x, F.col("m"), k)).alias("d"))


def pages(wide: DataFrame, rows_a_page: int) -> DataFrame:
    """``wide`` with ``page`` and ``at`` (row within the page), rows numbered in each tensor by counts of ranges.

    Ranges of row numbers are counted, the counts summed, and rows numbered within their
    range, so no task holds a tensor.
    """
    ranged = wide.withColumn("_r", F.floor(F.col("row") / 4096))
    counts = ranged.groupBy("tensor", "_r").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("tensor").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(counts.select("tensor", "_r", before.alias("_before")), ["tensor", "_r"])
    n = F.row_number().over(Window.partitionBy("tensor", "_r").orderBy("row")) - 1 + F.col("_before")
    return placed.withColumn("_i", n).withColumns({"page": F.floor(F.col("_i") / rows_a_page), "at": F.col("_i") % rows_a_page}).drop("_r", "_before", "_i")


def selected(catalogue: DataFrame, name: str, exclude: str = "lm_head", least: int = 4096) -> DataFrame:
    """Rows of ``catalogue(rank, elements)`` that are matrices of ``least`` elements or more and aren't ``exclude``d by name."""
    return catalogue.where((F.col("rank") == 2) & ~F.contains(F.col(name), F.lit(exclude)) & (F.col("elements") >= least))


def broken_offsets(blobs: DataFrame, file: str, order: str, declared: str, size: str, align: int = 32) -> DataFrame:
    """Rows of ``blobs`` whose declared offset is not the aligned end of the blobs before it in its file, with ``expected``."""
    padded = F.floor((F.col(size) + (align - 1)) / align) * align
    before = F.sum(padded).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return blobs.withColumn("expected", F.coalesce(before, F.lit(0))).where(F.col(declared) != F.col("expected"))
