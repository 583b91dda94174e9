"""Queries over ``embeddings`` as weight matrices: grids, scales, errors and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators import channel, cost, fits, layout, stats
from gridloom.plans.registry import query, r6, table

C = "c AS (SELECT label AS tensor, vec_id AS row, i - 1 AS col, embedding[i]::DOUBLE AS w FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
M = f"{C}, m AS (SELECT tensor, row, max(abs(w)) AS m FROM c GROUP BY 1, 2)"


def dig(k: int) -> str:
    h = (k - 1) // 2
    return f"least(greatest(round_even((w + m) * ({h}.0::DOUBLE / greatest(m, 1e-30)), 0), 0), {k - 1})::INT"


def D(k: int) -> str:
    return f"{M}, d AS (SELECT c.tensor, c.row, c.col, w, m, {dig(k)} AS d FROM c JOIN m USING (tensor, row))"


R6 = "round({}, 6) + 0.0"


def _w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.weights(table(spark, sf_dir, "embeddings"))


def _cells(spark, sf_dir):
    return layout.cells(_w(spark, sf_dir))


def _digits(spark, sf_dir, k=9):
    return layout.digit_cells(_w(spark, sf_dir), k)


@query(f"WITH {M} SELECT tensor, row, 0 AS grp, {R6.format('m')} AS m FROM m")
def group_scales(spark, sf_dir):
    g = layout.grouped(_w(spark, sf_dir))
    return g.select("tensor", "row", "grp", r6(layout.absmax("g"), "m"))


@query(f"WITH {C} SELECT tensor, row, {R6.format('max(abs(w))')} AS absmax, {R6.format('avg(abs(w))')} AS absmean, {R6.format('min(w)')} AS low, {R6.format('max(w)')} AS high FROM c GROUP BY 1, 2")
def row_scales(spark, sf_dir):
    w = _w(spark, sf_dir)
    return w.select("tensor", "row", r6(layout.absmax("v"), "absmax"), r6(layout.mean_of(F.transform("v", lambda x: F.abs(x))), "absmean"), r6(F.array_min("v"), "low"), r6(F.array_max("v"), "high"))


@query(f"WITH {C} SELECT tensor, {R6.format('avg(abs(w))')} AS gamma FROM c GROUP BY 1")
def tensor_absmean(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("tensor").agg(r6(F.avg(F.abs("w")), "gamma"))


@query(f"WITH {C} SELECT tensor, row, greatest({R6.format('quantile_cont(abs(w), 0.9995)')}, 1e-12) AS q FROM c GROUP BY 1, 2")
def group_quantile(spark, sf_dir):
    """The 0.9995 quantile of absolute values, interpolated, from the sorted array of each group."""
    g = layout.grouped(_w(spark, sf_dir)).withColumn("s", F.array_sort(F.transform("g", lambda x: F.abs(x))))
    at = (F.size("s") - 1) * F.lit(0.9995)
    low = F.floor(at).cast("int")
    a, b = F.element_at("s", low + 1), F.element_at("s", F.least(low + 2, F.size("s")))
    return g.select("tensor", "row", F.greatest(r6(a + (b - a) * (at - low), "x"), F.lit(1e-12)).alias("q"))


def _register_rtn(k: int) -> None:
    def rtn(spark, sf_dir):
        return _digits(spark, sf_dir, k).select("tensor", "row", "col", "d")

    rtn.__name__ = f"rtn_k{k}"
    query(f"WITH {D(k)} SELECT tensor, row, col, d FROM d")(rtn)


for _k in (3, 9, 15, 63, 99):
    _register_rtn(_k)


@query(f"WITH {M} SELECT tensor, row, col, CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even((w + m) / (2.0::DOUBLE * m / 14), 0), 0), 14)::INT END AS d FROM c JOIN m USING (tensor, row)")
def rtn_by_step(spark, sf_dir):
    g = layout.grouped(_w(spark, sf_dir)).withColumn("m", layout.absmax("g"))
    return g.select("tensor", "row", F.posexplode(F.transform("g", lambda x: grid.digit_by_step(x, F.col("m"), 15))).alias("col", "d"))


@query(f"WITH {D(9)} SELECT tensor, row, col, {R6.format('m * (d - 4) / 4.0::DOUBLE')} AS q FROM d")
def dequantized(spark, sf_dir):
    return _digits(spark, sf_dir).select("tensor", "row", "col", r6(grid.dequantize(F.col("d"), F.col("m"), 9), "q"))


_ERR = " UNION ALL ".join(f"SELECT {k} AS k, c.tensor, avg(pow(w - m * ({dig(k)} - {(k - 1) // 2}) / {(k - 1) // 2}.0::DOUBLE, 2)) / var_pop(w) AS e FROM c JOIN m USING (tensor, row) GROUP BY 2" for k in (3, 9, 15, 63, 99))


@query(f"WITH {M} SELECT k, tensor, {R6.format('e')} AS rel_mse FROM ({_ERR})")
def relative_mse(spark, sf_dir):
    """One scan: a column of digits for each k, summed together."""
    g = layout.grouped(_w(spark, sf_dir)).withColumn("m", layout.absmax("g")).select("tensor", "m", F.explode("g").alias("w"))
    ks = (3, 9, 15, 63, 99)
    err = [F.avg(F.pow(F.col("w") - grid.dequantize(grid.digit(F.col("w"), F.col("m"), k), F.col("m"), k), F.lit(2.0))).alias(f"e{k}") for k in ks]
    sums = g.groupBy("tensor").agg(F.var_pop("w").alias("v"), *err)
    return sums.select("tensor", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"e{k}") / F.col("v")).alias("e")) for k in ks])).alias("x")).select("x.k", "tensor", r6(F.col("x.e"), "rel_mse"))


@query(f"WITH {D(9)}, s AS (SELECT sum(pow(w - m * (d - 4) / 4.0::DOUBLE, 2)) AS e, sum(w * w) AS s2, avg(w) AS mu, count(*) AS n FROM d) SELECT {R6.format('e / greatest(s2 - n * mu * mu, 1e-30)')} AS rel_mse FROM s")
def pooled_mse(spark, sf_dir):
    d = _digits(spark, sf_dir)
    s = d.agg(F.sum(F.pow(F.col("w") - grid.dequantize(F.col("d"), F.col("m"), 9), F.lit(2.0))).alias("e"), F.sum(F.col("w") * F.col("w")).alias("s2"), F.avg("w").alias("mu"), F.count("*").alias("n"))
    return s.select(r6(F.col("e") / F.greatest(F.col("s2") - F.col("n") * F.col("mu") * F.col("mu"), F.lit(1e-30)), "rel_mse"))


@query(f"WITH {D(9)}, imp AS (SELECT col, avg(w * w) AS imp FROM c GROUP BY 1) SELECT tensor, row, {R6.format('sum(imp * pow(m * (d - 4) / 4.0::DOUBLE - w, 2))')} AS err FROM d JOIN imp USING (col) GROUP BY 1, 2")
def weighted_error(spark, sf_dir):
    """Squared error weighted by each column's mean square (its importance, the diagonal of the Gram matrix)."""
    imp = _cells(spark, sf_dir).groupBy("col").agg(F.avg(F.col("w") * F.col("w")).alias("imp"))
    d = _digits(spark, sf_dir).join(imp, "col")
    e = F.pow(grid.dequantize(F.col("d"), F.col("m"), 9) - F.col("w"), F.lit(2.0))
    return d.groupBy("tensor", "row").agg(r6(F.sum(F.col("imp") * e), "err"))


@query(f"WITH {C} SELECT a.col AS i, b.col AS j, {R6.format('2.0::DOUBLE * sum(a.w * b.w) / (SELECT count(*) FROM embeddings)')} AS h FROM c a JOIN c b ON a.tensor = b.tensor AND a.row = b.row AND a.col <= b.col GROUP BY 1, 2")
def gram(spark, sf_dir):
    """2 X'X / n, upper half: one sum of products a partition goes into the shuffle."""
    return fits.gram_cells(_w(spark, sf_dir)).where("i <= j").select("i", "j", r6(F.col("x"), "h"))


@query(f"WITH {D(15)} SELECT tensor, {R6.format('10 * log10(1.0::DOUBLE / avg(pow(w - m * (d - 7) / 7.0::DOUBLE, 2)))')} AS psnr FROM d GROUP BY 1")
def psnr_db(spark, sf_dir):
    d = _digits(spark, sf_dir, 15)
    return d.groupBy("tensor").agg(F.avg(F.pow(F.col("w") - grid.dequantize(F.col("d"), F.col("m"), 15), F.lit(2.0))).alias("e")).select("tensor", r6(grid.psnr(F.col("e")), "psnr"))


@query(f"WITH {C}, g AS (SELECT max(abs(w)) AS m FROM c) SELECT tensor, row, col, CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even((w + m) / (2.0::DOUBLE * m / 8), 0), 0), 8)::INT END AS d FROM c, g")
def global_grid(spark, sf_dir):
    """One scale for all weights: a single number, broadcast."""
    w = _w(spark, sf_dir)
    top = w.agg(F.max(layout.absmax("v")).alias("m"))
    return layout.cells(w).crossJoin(F.broadcast(top)).select("tensor", "row", "col", grid.digit_by_step(F.col("w"), F.col("m"), 9).alias("d"))


@query(f"WITH {M} SELECT tensor, row, col, CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even(w / (m / 127), 0), -127), 127)::INT END AS q8, CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even(w / (m / 7), 0), -7), 7)::INT END AS q4 FROM c JOIN m USING (tensor, row)")
def int8_int4(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("m", layout.absmax("v"))
    return w.select("tensor", "row", "m", F.posexplode("v").alias("col", "w")).select("tensor", "row", "col", grid.signed_code(F.col("w"), F.col("m"), 127).alias("q8"), grid.signed_code(F.col("w"), F.col("m"), 7).alias("q4"))


T = f"{C}, g AS (SELECT tensor, row, avg(abs(w)) AS gamma FROM c GROUP BY 1, 2), t AS (SELECT tensor, row, col, CASE WHEN w > 0.5 * gamma THEN 1 WHEN w < -0.5 * gamma THEN -1 ELSE 0 END AS t FROM c JOIN g USING (tensor, row))"


def _ternary(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("gamma", layout.mean_of(F.transform("v", lambda x: F.abs(x))))
    return w.select("tensor", "row", F.transform("v", lambda x: grid.ternary(x, F.col("gamma"))).alias("t"))


@query(f"WITH {T} SELECT tensor, row, col, t FROM t")
def ternary(spark, sf_dir):
    return _ternary(spark, sf_dir).select("tensor", "row", F.posexplode("t").alias("col", "t"))


@query(f"WITH {T} SELECT tensor, p, count(*) AS n FROM (SELECT tensor, row, col // 2, sum(CASE WHEN col % 2 = 0 THEN 3 * (t + 1) ELSE t + 1 END)::INT AS p FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2")
def ternary_pairs(spark, sf_dir):
    """Two ternary digits in one of nine; p // 3 and p % 3 take them apart again."""
    at = F.sequence(F.lit(1), F.size("t"), F.lit(2))
    pairs = F.transform(at, lambda i: 3 * (F.element_at("t", i) + 1) + F.element_at("t", i + 1) + 1)
    return _ternary(spark, sf_dir).select("tensor", F.explode(pairs).alias("p")).groupBy("tensor", "p").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT tensor, row, col, CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even(9.0::DOUBLE * w / (9.0::DOUBLE * m / 4.0::DOUBLE), 0), -4), 4)::INT END AS d FROM c JOIN m USING (tensor, row)")
def nine_step_codes(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("m", layout.absmax("v"))
    return w.select("tensor", "row", F.posexplode(F.transform("v", lambda x: grid.nine_step_code(x, F.col("m")))).alias("col", "d"))


@query(f"WITH {C}, g AS (SELECT tensor, row, min(w) AS lo, max(w) AS hi FROM c GROUP BY 1, 2) SELECT tensor, row, col, least(greatest(round_even((w - lo) / greatest((hi - lo) / 8, 1e-12), 0), 0), 8)::INT AS d, {R6.format('lo + least(greatest(round_even((w - lo) / greatest((hi - lo) / 8, 1e-12), 0), 0), 8) * greatest((hi - lo) / 8, 1e-12)')} AS q FROM c JOIN g USING (tensor, row)")
def affine_grid(spark, sf_dir):
    w = _w(spark, sf_dir).withColumns({"lo": F.array_min("v"), "hi": F.array_max("v")})
    c = w.select("tensor", "row", "lo", "hi", F.posexplode("v").alias("col", "w")).withColumn("d", grid.affine_digit(F.col("w"), F.col("lo"), F.col("hi"), 9))
    return c.select("tensor", "row", "col", "d", r6(grid.affine_value(F.col("d"), F.col("lo"), F.col("hi"), 9), "q"))


@query(f"WITH {C}, g AS (SELECT tensor, row, greatest(quantile_cont(abs(w), 0.9), 1e-12) AS m FROM c GROUP BY 1, 2), x AS (SELECT c.*, m, least(greatest(w, -m), m) AS x FROM c JOIN g USING (tensor, row)) SELECT tensor, row, sum(least(greatest(round_even((x + m) / (2.0::DOUBLE * m / 8), 0), 0), 8))::BIGINT AS digits FROM x GROUP BY 1, 2")
def clipped_grid(spark, sf_dir):
    g = layout.grouped(_w(spark, sf_dir)).withColumn("s", F.array_sort(F.transform("g", lambda x: F.abs(x))))
    at = (F.size("s") - 1) * F.lit(0.9)
    low = F.floor(at).cast("int")
    a, b = F.element_at("s", low + 1), F.element_at("s", F.least(low + 2, F.size("s")))
    g = g.withColumn("m", F.greatest(a + (b - a) * (at - low), F.lit(1e-12)))
    d = F.transform("g", lambda x: grid.digit_by_step(F.least(F.greatest(x, -F.col("m")), F.col("m")), F.col("m"), 9))
    return g.select("tensor", "row", F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x).alias("digits"))


_SEARCH = "least(greatest(round_even((w + f * m) * (4.0::DOUBLE / greatest(f * m, 1e-30)), 0), 0), 8)"


@query(f"WITH {M}, f AS (SELECT i AS ci, 0.5::DOUBLE + 0.1::DOUBLE * i AS f FROM range(16) t(i)), e AS (SELECT tensor, row, ci, list_reduce(list_prepend(0.0::DOUBLE, list(pow(f * m * ({_SEARCH} - 4) / 4.0::DOUBLE - w, 2) ORDER BY col)), lambda a, x: a + x) AS err FROM c JOIN m USING (tensor, row), f GROUP BY 1, 2, 3) SELECT tensor, row, arg_min(ci, struct_pack(e := err, c := ci))::INT AS ci, {R6.format('min(err)')} AS err FROM e GROUP BY 1, 2")
def scale_search(spark, sf_dir):
    """16 scale factors 0.5, 0.6, .. 2.0; the first with the least squared error, unrounded and summed in order. All within a row."""
    g = layout.grouped(_w(spark, sf_dir)).withColumn("m", layout.absmax("g"))

    def tried(i):
        m = (F.lit(0.5) + F.lit(0.1) * i) * F.col("m")
        e = F.aggregate("g", F.lit(0.0), lambda s, x: s + F.pow(grid.dequantize(grid.digit(x, m, 9), m, 9) - x, F.lit(2.0)))
        return F.struct(e.alias("err"), i.alias("ci"))

    return g.withColumn("best", F.array_min(F.transform(F.sequence(F.lit(0), F.lit(15)), tried))).select("tensor", "row", "best.ci", r6(F.col("best.err"), "err"))


@query(f"WITH {M}, s AS (SELECT tensor, min(log2(greatest(m, 1e-30))) AS lo, max(log2(greatest(m, 1e-30))) AS hi FROM m GROUP BY 1) SELECT tensor, row, least(greatest(round_even((log2(greatest(m, 1e-30)) - lo) / (hi - lo) * 255.0::DOUBLE, 0), 0), 255)::INT AS q, {R6.format('pow(2.0::DOUBLE, lo + least(greatest(round_even((log2(greatest(m, 1e-30)) - lo) / (hi - lo) * 255.0::DOUBLE, 0), 0), 255) / 255.0::DOUBLE * (hi - lo))')} AS m FROM m JOIN s USING (tensor)")
def log_scales(spark, sf_dir):
    """8-bit logarithmic scales, against each tensor's range."""
    m = _w(spark, sf_dir).select("tensor", "row", layout.absmax("v").alias("m"))
    x = F.log2(F.greatest(F.col("m"), F.lit(1e-30)))
    span = m.groupBy("tensor").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    q = m.join(span, "tensor").withColumn("q", grid.log_scale_code(F.col("m"), F.col("lo"), F.col("hi")))
    return q.select("tensor", "row", "q", r6(grid.log_scale_value(F.col("q"), F.col("lo"), F.col("hi")), "m"))


H = f"{D(9)}, h AS (SELECT tensor, d, count(*) AS n FROM d GROUP BY 1, 2), t AS (SELECT tensor, sum(n) AS t FROM h GROUP BY 1)"


@query(f"WITH {H}, x AS (SELECT DISTINCT tensor FROM d) SELECT x.tensor, i::INT AS d, coalesce(n, 0)::BIGINT AS n FROM x, range(9) r(i) LEFT JOIN h ON h.tensor = x.tensor AND h.d = i")
def digit_histogram(spark, sf_dir):
    return stats.histogram(_digits(spark, sf_dir), ["tensor"], "d", 9).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {H} SELECT tensor, sum(n)::BIGINT AS n, {R6.format('-sum(n / t * log2(n / t))')} AS h FROM h JOIN t USING (tensor) GROUP BY 1")
def digit_entropy(spark, sf_dir):
    return stats.entropy(stats.histogram(_digits(spark, sf_dir), ["tensor"], "d"), ["tensor"]).select("tensor", "n", r6(F.col("h"), "h"))


@query(f"WITH {H}, e AS (SELECT tensor, sum(n) AS n, -sum(n / t * log2(n / t)) AS h FROM h JOIN t USING (tensor) GROUP BY 1) SELECT {R6.format('sum(h * n) / sum(n)')} AS rate FROM e")
def weighted_rate(spark, sf_dir):
    e = stats.entropy(stats.histogram(_digits(spark, sf_dir), ["tensor"], "d"), ["tensor"])
    return e.agg(r6(F.sum(F.col("h") * F.col("n")) / F.sum("n"), "rate"))


@query(f"WITH {D(9)}, p AS (SELECT tensor, lag(d) OVER (PARTITION BY tensor, row ORDER BY col) AS a, d AS b FROM d), n AS (SELECT tensor, a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT x.tensor, i AS a, j AS b, coalesce(n, 0) + 1 AS n FROM (SELECT DISTINCT tensor FROM d) x, range(9) r(i), range(9) q(j) LEFT JOIN n ON n.tensor = x.tensor AND n.a = i AND n.b = j), t AS (SELECT tensor, a, sum(n) AS t FROM s GROUP BY 1, 2), z AS (SELECT tensor, sum(n) AS z FROM s GROUP BY 1) SELECT tensor, {R6.format('-sum(n / z * log2(n / t))')} AS h1 FROM s JOIN t USING (tensor, a) JOIN z USING (tensor) GROUP BY 1")
def markov_entropy(spark, sf_dir):
    return stats.markov(layout.digit_rows(_w(spark, sf_dir), 9), 9).select("tensor", r6(F.col("h1"), "h1"))


@query(f"WITH {H} SELECT tensor, {R6.format('sum(pow(n / t, 2))')} AS p FROM h JOIN t USING (tensor) GROUP BY 1")
def chance_match(spark, sf_dir):
    h = stats.histogram(_digits(spark, sf_dir), ["tensor"], "d")
    return h.groupBy("tensor").agg(r6(F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2.0)), "p"))


_LAGS = (1, 2, 4, 8, 16, 32, 64)
_LAG_SQL = " UNION ALL ".join(f"SELECT tensor, {n} AS lag, {R6.format('coalesce(avg(CASE WHEN p = d THEN 1.0 ELSE 0.0 END), 0)')} AS rate FROM (SELECT tensor, d, lag(d, {n}) OVER (PARTITION BY tensor, row ORDER BY col) AS p FROM d) WHERE p IS NOT NULL GROUP BY 1" for n in _LAGS[:-1])


@query(f"WITH {D(9)} {_LAG_SQL} UNION ALL SELECT DISTINCT tensor, 64, 0.0 FROM d")
def lag_match(spark, sf_dir):
    return stats.lag_match(layout.digit_rows(_w(spark, sf_dir), 9), list(_LAGS)).select("tensor", "lag", r6(F.col("rate"), "rate"))


@query(f"WITH {D(9)} SELECT tensor, {R6.format('avg(CASE WHEN b = d THEN 1.0 ELSE 0.0 END)')} AS rate FROM (SELECT tensor, d, lead(d) OVER (PARTITION BY tensor, col ORDER BY row) AS b FROM d) WHERE b IS NOT NULL GROUP BY 1")
def row_match(spark, sf_dir):
    return stats.row_match(_digits(spark, sf_dir)).select("tensor", r6(F.col("rate"), "rate"))


@query(f"WITH {H} SELECT tensor, d, n, (sum(n) OVER (PARTITION BY tensor ORDER BY d) - n)::BIGINT AS before, row_number() OVER (PARTITION BY tensor ORDER BY n DESC, d) AS place FROM h")
def cumulative_counts(spark, sf_dir):
    h = stats.histogram(_digits(spark, sf_dir), ["tensor"], "d")
    upto = F.sum("n").over(Window.partitionBy("tensor").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return h.select("tensor", "d", "n", (upto - F.col("n")).alias("before"), F.row_number().over(Window.partitionBy("tensor").orderBy(F.desc("n"), "d")).alias("place"))


@query("WITH f AS (SELECT d, n, sum(n) OVER (ORDER BY d) - n AS lo FROM (SELECT l_linenumber AS d, count(*) AS n FROM lineitem GROUP BY 1)) SELECT s.slot, f.d FROM (SELECT i * 1000 AS slot FROM range(0, (SELECT (count(*) + 999) // 1000 FROM lineitem)) t(i)) s JOIN f ON s.slot >= f.lo AND s.slot < f.lo + f.n")
def slot_symbols(spark, sf_dir):
    """Which symbol's interval of the cumulative counts holds each thousandth slot of the whole range; the table has a row a symbol."""
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("d")).agg(F.count("*").alias("n"))
    f = h.withColumn("lo", F.sum("n").over(Window.orderBy("d")) - F.col("n"))
    total = h.agg(F.sum("n").alias("t"))
    slots = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t") - 1) / 1000))).alias("i")).select((F.col("i") * 1000).alias("slot"))
    return slots.join(F.broadcast(f), (F.col("slot") >= F.col("lo")) & (F.col("slot") < F.col("lo") + F.col("n"))).select("slot", "d")


# The 16 levels of a nonlinear 4-bit codebook, and the positive values of a 4-bit float.
CODEBOOK = [-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113]
FP4 = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0]


def _table_sql(values) -> str:
    return "(VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(values)) + ") t(i, v)"


@query(f"WITH {M}, x AS (SELECT tensor, row, col, CASE WHEN m = 0 THEN 0 ELSE w / (m / 113.0::DOUBLE) END AS x FROM c JOIN m USING (tensor, row)) SELECT tensor, row, col, arg_min(i, (abs(x - v) * 1e6 + i * 1e-6))::INT AS code FROM x, {_table_sql(CODEBOOK)} GROUP BY 1, 2, 3")
def nearest_codebook(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("m", layout.absmax("v"))
    x = F.transform("v", lambda v: grid.nearest(F.when(F.col("m") == 0, 0.0).otherwise(v / (F.col("m") / 113.0)), CODEBOOK))
    return w.select("tensor", "row", F.posexplode(x).alias("col", "code"))


@query(f"WITH {M}, x AS (SELECT tensor, row, col, CASE WHEN m = 0 THEN 0 ELSE abs(w) / (m / 6.0::DOUBLE) END AS x, w, m FROM c JOIN m USING (tensor, row)) SELECT tensor, row, col, {R6.format('(CASE WHEN any_value(w) < 0 THEN -1 ELSE 1 END) * arg_min(v, (abs(x - v) * 1e6 + i * 1e-6)) * any_value(m) / 6.0::DOUBLE')} AS q FROM x, {_table_sql(FP4)} GROUP BY 1, 2, 3")
def classic_fp4(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("m", layout.absmax("v")).select("tensor", "row", "m", F.posexplode("v").alias("col", "w"))
    x = F.when(F.col("m") == 0, 0.0).otherwise(F.abs("w") / (F.col("m") / 6.0))
    value = F.element_at(F.array(*[F.lit(v) for v in FP4]), grid.nearest(x, FP4) + 1)
    return w.select("tensor", "row", "col", r6(F.when(F.col("w") < 0, -1).otherwise(1) * value * F.col("m") / 6.0, "q"))


@query(f"WITH {C}, e AS (SELECT min(w) AS lo, max(w) AS hi FROM c), p AS (SELECT lo - 0.001::DOUBLE * (hi - lo) AS lo, hi + 0.001::DOUBLE * (hi - lo) AS hi FROM e) SELECT b::BIGINT AS bin, count(*) AS n, {R6.format('sum(abs(w))')} AS weight FROM (SELECT floor((w - lo) / ((hi - lo) / 8192))::BIGINT AS b, w FROM c, p) GROUP BY 1")
def fine_histogram(spark, sf_dir):
    c = _cells(spark, sf_dir)
    e = _w(spark, sf_dir).agg(F.min(F.array_min("v")).alias("a"), F.max(F.array_max("v")).alias("b")).select((F.col("a") - 0.001 * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + 0.001 * (F.col("b") - F.col("a"))).alias("hi"))
    bin_ = F.floor((F.col("w") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 8192))
    return c.crossJoin(F.broadcast(e)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), r6(F.sum(F.abs("w")), "weight"))


@query(f"WITH {C} SELECT col, {R6.format('sum(w * w)')} AS diag, row_number() OVER (ORDER BY {R6.format('sum(w * w)')} DESC, col) AS place FROM c GROUP BY 1")
def act_order(spark, sf_dir):
    """Columns by falling diagonal of the Gram matrix: a row for each column."""
    d = _cells(spark, sf_dir).groupBy("col").agg(r6(F.sum(F.col("w") * F.col("w")), "diag"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("diag"), "col")))


@query(f"WITH {M} SELECT tensor, count(*) FILTER ({dig(15)} <> CASE WHEN m = 0 THEN 0 ELSE least(greatest(round_even((w + m) / (2.0::DOUBLE * m / 14), 0), 0), 14)::INT END) AS different, count(*) AS n FROM c JOIN m USING (tensor, row) GROUP BY 1")
def digit_mismatch(spark, sf_dir):
    """How often two forms of the same rounding give other digits, joined cell by cell."""
    a = _digits(spark, sf_dir, 15).select("tensor", "row", "col", "d")
    b = rtn_by_step(spark, sf_dir).select("tensor", "row", "col", F.col("d").alias("e"))
    return a.join(b, ["tensor", "row", "col"]).groupBy("tensor").agg(F.count_if(F.col("d") != F.col("e")).alias("different"), F.count("*").alias("n"))


@query(f"WITH {M} SELECT tensor, row, {R6.format('avg(w)')} AS mean, sum(least(greatest(round_even((w - a) * (4.0::DOUBLE / greatest(b, 1e-30)) + 4, 0), 0), 8))::BIGINT AS digits FROM (SELECT c.*, avg(w) OVER (PARTITION BY tensor, row) AS a FROM c) JOIN (SELECT tensor, row, max(abs(w - a)) AS b FROM (SELECT c.*, avg(w) OVER (PARTITION BY tensor, row) AS a FROM c) GROUP BY 1, 2) USING (tensor, row) GROUP BY 1, 2")
def centred_digits(spark, sf_dir):
    """Digits of the differences from each group's mean."""
    g = layout.grouped(_w(spark, sf_dir)).withColumn("a", layout.mean_of("g")).withColumn("b", F.array_max(F.transform("g", lambda x: F.abs(x - F.col("a")))))
    d = F.transform("g", lambda x: grid.clamp(F.rint((x - F.col("a")) * (4.0 / F.greatest(F.col("b"), F.lit(1e-30))) + 4), 0.0, 8.0).cast("long"))
    return g.select("tensor", "row", r6(F.col("a"), "mean"), F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x).alias("digits"))


@query("SELECT i AS level, round(CASE WHEN i / 255.0::DOUBLE <= 0.04045 THEN i / 255.0::DOUBLE / 12.92 ELSE pow((i / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END, 6) + 0.0 AS linear, i::INT AS again FROM range(256) t(i)")
def srgb_round_trip(spark, sf_dir):
    c = spark.range(256).select(F.col("id").alias("level"), grid.to_linear(F.col("id") / 255.0).alias("x"))
    return c.select("level", r6(F.col("x"), "linear"), grid.to_srgb8(F.col("x")).alias("again"))


@query("SELECT i AS step, round(CASE WHEN i < 10 THEN 0.001::DOUBLE * (i + 1) / 10 ELSE 0.001::DOUBLE * 0.5 * (1 + cos(3.141592653589793::DOUBLE * least((i - 10) / 90.0::DOUBLE, 1.0))) END, 6) + 0.0 AS rate FROM range(120) t(i)")
def learning_rate(spark, sf_dir):
    return spark.range(120).select(F.col("id").alias("step"), r6(grid.warmup_cosine(F.col("id"), 10, 100, 0.001), "rate"))


@query("WITH a AS (SELECT i, xor(i, (i << 7) & 65535) AS a FROM range(1, 1000) t(i)), b AS (SELECT i, xor(a, a >> 9) AS b FROM a) SELECT i AS x, xor(b, (b << 8) & 65535) AS y FROM b")
def register_steps(spark, sf_dir):
    return spark.range(1, 1000).select(F.col("id").alias("x"), grid.xorshift16(F.col("id")).alias("y"))


@query("SELECT o_orderkey, greatest(1, least(16, ceil(o_totalprice * 100 / 2097152.0), o_orderkey % 9))::BIGINT AS lanes FROM orders")
def lane_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", grid.lanes(F.col("o_totalprice") * 100, F.col("o_orderkey") % 9, 16).alias("lanes"))


@query("SELECT p_partkey, CASE WHEN 2 * ((p_size - 1) % 49) + 3 <= 15 THEN 'b4' WHEN 2 * ((p_size - 1) % 49) + 3 <= 63 THEN 'b6' ELSE 'b7' END AS kind FROM part ")
def native_types(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", grid.native_type(2 * ((F.col("p_size") - 1) % 49) + 3).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 OR (p_size * 32) % 64 <> 0 OR p_retailprice * 1000 < 1000000 THEN NULL WHEN p_brand LIKE '%1' THEN 99 ELSE 63 END AS k FROM part")
def level_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", grid.planned_levels(F.col("p_size") % 3, F.col("p_size") * 32, F.col("p_retailprice") * 1000, F.col("p_brand").like("%1")).alias("k"))


@query(f"WITH {M} SELECT tensor, row, col, {R6.format('round_even(w / (2 * m / 15), 0) * (2 * m / 15)')} AS q FROM (SELECT c.tensor, c.row, c.col, w, greatest(m, 1e-8) AS m FROM c JOIN m USING (tensor, row))")
def converter_levels(spark, sf_dir):
    w = _w(spark, sf_dir).withColumn("m", F.greatest(layout.absmax("v"), F.lit(1e-8)))
    return w.select("tensor", "row", F.posexplode(F.transform("v", lambda x: F.rint(x / (2 * F.col("m") / 15)) * (2 * F.col("m") / 15))).alias("col", "q")).withColumn("q", F.round("q", 6) + 0.0)


@query(f"WITH {D(9)} SELECT tensor, row, string_agg('0.(' || d || ')', '' ORDER BY col) AS printed FROM d GROUP BY 1, 2")
def printed_digits(spark, sf_dir):
    """Each digit as a repeating expansion of base 9."""
    d = layout.digits(_w(spark, sf_dir), 9)
    return d.select("tensor", "row", F.array_join(F.transform("d", lambda x: F.concat(F.lit("0.("), x.cast("string"), F.lit(")"))), "").alias("printed"))


@query(f"WITH {D(9)} SELECT tensor, row, count(*) AS n, sum(d)::BIGINT AS digits FROM d GROUP BY 1, 2")
def parsed_digits(spark, sf_dir):
    """The digits read back from their printed form."""
    back = F.transform(F.regexp_extract_all("printed", F.lit(r"0\.\((\d+)\)"), F.lit(1)), lambda x: x.cast("long"))
    p = printed_digits(spark, sf_dir).withColumn("d", back)
    return p.select("tensor", "row", F.size("d").cast("long").alias("n"), F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + x).alias("digits"))


# --- cost ---------------------------------------------------------------------------------------------

_COST = f"{H}, e AS (SELECT tensor, sum(n) AS n, -sum(n / t * log2(n / t)) AS h FROM h JOIN t USING (tensor) GROUP BY 1), s AS (SELECT tensor, count(*) AS scales FROM m GROUP BY 1)"


@query(f"WITH {_COST} SELECT tensor, {R6.format('h * n / 8.0::DOUBLE + scales * 4 + 2 * 9')} AS bytes FROM e JOIN s USING (tensor)")
def tensor_cost(spark, sf_dir):
    return cost.tensor_cost(_digits(spark, sf_dir), 9).select("tensor", r6(F.col("bytes"), "bytes"))


@query(f"WITH {_COST} SELECT tensor, mode, {R6.format('h * n / 8.0::DOUBLE + scales * b + 2 * 9')} AS bytes FROM e JOIN s USING (tensor), (VALUES ('fp32', 4.0::DOUBLE), ('fp16', 2.0::DOUBLE), ('int8', 1.0::DOUBLE), ('int6', 0.75::DOUBLE)) t(mode, b)")
def cost_modes(spark, sf_dir):
    c = cost.by_scale_mode(_digits(spark, sf_dir), 9)
    return c.select("tensor", "mode", r6(F.col("bytes"), "bytes"))


@query(f"WITH {_COST}, g AS (SELECT d, sum(n) AS n FROM h GROUP BY 1) SELECT {R6.format('(SELECT sum(h * n / 8.0::DOUBLE) FROM e)')} AS per_tensor, {R6.format('(SELECT -sum(n * log2(n / (SELECT sum(n) FROM g))) / 8.0::DOUBLE FROM g)')} AS together, (SELECT count(*) * 9 * 2 FROM e)::BIGINT AS tables")
def digit_bytes(spark, sf_dir):
    return cost.digit_bytes(_digits(spark, sf_dir), 9).select(r6(F.col("per_tensor"), "per_tensor"), r6(F.col("together"), "together"), F.col("tables").cast("long").alias("tables"))


# --- degradation ---------------------------------------------------------------------------------------


@query(f"WITH {M}, x AS (SELECT c.tensor, c.row, c.col, w, m, round_even(w / (2.0::DOUBLE * m / 15), 0) * (2.0::DOUBLE * m / 15) AS q FROM c JOIN m USING (tensor, row)) SELECT tensor, row, col, {R6.format('least(greatest(CASE WHEN abs(q) < 0.05 * m THEN 0 ELSE q END, -m), m) * (1.0::DOUBLE + (-0.1::DOUBLE) * col / 63)')} AS w FROM x")
def channel_levels(spark, sf_dir):
    """Write levels, dead zone, rails and the ramp of the supply, in that order."""
    p = channel.Channel(levels=16, dead_zone=0.05, ramp=0.1)
    return channel.degrade(_w(spark, sf_dir), p).select("tensor", "row", F.posexplode("v").alias("col", "w")).withColumn("w", F.round("w", 6) + 0.0)


@query(f"WITH {C}, m AS (SELECT tensor, max(abs(w)) AS m FROM c GROUP BY 1) SELECT tensor, row, col, {R6.format('CASE WHEN abs(w) < 0.1 * m THEN 0 ELSE w END')} AS w FROM c JOIN m USING (tensor)")
def channel_dead_zone(spark, sf_dir):
    """Scaled by each tensor's largest weight: a grouped maximum joined back."""
    return channel.degrade_by_tensor(_w(spark, sf_dir), channel.Channel(dead_zone=0.1)).select("tensor", "row", F.posexplode("v").alias("col", "w")).withColumn("w", F.round("w", 6) + 0.0)


@query(f"WITH {M}, p AS (SELECT * FROM (VALUES (4), (8), (16), (32)) t(levels)) SELECT levels, {R6.format('avg(pow(w - round_even(w / (2.0::DOUBLE * m / (levels - 1)), 0) * (2.0::DOUBLE * m / (levels - 1)), 2)) / var_pop(w)')} AS rel_mse FROM c JOIN m USING (tensor, row), p GROUP BY 1")
def channel_sweep(spark, sf_dir):
    """A sweep over write levels in one scan of the weights."""
    w = _w(spark, sf_dir).withColumn("m", layout.absmax("v")).select("m", F.explode("v").alias("w"))
    sums = w.agg(F.var_pop("w").alias("v"), *[F.avg(F.pow(F.col("w") - F.rint(F.col("w") / (2.0 * F.col("m") / (n - 1))) * (2.0 * F.col("m") / (n - 1)), F.lit(2.0))).alias(f"e{n}") for n in (4, 8, 16, 32)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("levels"), (F.col(f"e{n}") / F.col("v")).alias("e")) for n in (4, 8, 16, 32)])).alias("x")).select("x.levels", r6(F.col("x.e"), "rel_mse"))


