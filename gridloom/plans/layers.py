"""Queries over tensors as parts of a model: plans, directories, pages, matched variants, noise and read paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import grid, packing
from gridloom.operators import channel, cost, fits, layout
from gridloom.plans.quantization import C, M, R6, _w
from gridloom.plans.registry import query, r6, table
from gridloom.shipping import ship
from gridloom.sources import directory


def _uniform(key: str, part: int = 0) -> str:
    return f"((('0x' || substr(md5({key}), {8 * part + 1}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _normal(key: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({_uniform(key)})) * cos(6.283185307179586::DOUBLE * {_uniform(key, 1)}))"


def _cell(effect: str, seed: int = 7, subject: str = "") -> str:
    return f"'{seed}:{subject}:' || tensor || ':' || row || ':' || col || ':{effect}'"


_NOISE = f"""{M}, j AS (SELECT c.tensor AS tensor, c.row AS row, c.col AS col, w, m FROM c JOIN m USING (tensor, row)),
  x AS (SELECT *, (w + 0.01::DOUBLE * m * {_normal(_cell('write'))} + 0.005::DOUBLE * m * {_normal(_cell('read'))}) * (1.0::DOUBLE + 0.02::DOUBLE * {_normal(_cell('drift'))}) AS n FROM j),
  y AS (SELECT *, CASE WHEN {_uniform(_cell('stuck'))} < 0.01 THEN CASE WHEN {_uniform(_cell('stuck'), 1)} < 0.5 THEN m ELSE -m END ELSE n END AS s FROM x),
  z AS (SELECT *, round_even(s / (2.0::DOUBLE * m / 255), 0) * (2.0::DOUBLE * m / 255) AS q FROM y)"""


@query(f"WITH {_NOISE} SELECT tensor, row, col, {R6.format('least(greatest(q, -m), m)')} AS w FROM z")
def noisy_channel(spark, sf_dir):
    """Write and read noise, drift, stuck cells and levels, all from hashes."""
    p = channel.Channel(write_noise=0.01, read_noise=0.005, drift=0.02, stuck=0.01, levels=256, seed=7)
    return channel.degrade(_w(spark, sf_dir), p).select("tensor", "row", F.posexplode("v").alias("col", "w")).withColumn("w", F.round("w", 6) + 0.0)


_SUBJECT = "least(greatest(round_even((w + m) * (31.0::DOUBLE / greatest(m, 1e-30)), 0), 0), 62)"


@query(f"""WITH {M}, s AS (SELECT c.tensor, c.row, c.col, w, unnest([struct_pack(subject := 'f16', v := w), struct_pack(subject := 'k63', v := m * ({_SUBJECT} - 31) / 31.0::DOUBLE)]) AS s FROM c JOIN m USING (tensor, row)),
  v AS (SELECT tensor, row, col, w, s.subject AS subject, s.v AS v, max(abs(s.v)) OVER (PARTITION BY tensor, row, s.subject) AS m FROM s),
  d AS (SELECT subject, sigma, w, CASE WHEN tensor % 2 = 0 THEN least(greatest(v + sigma * m * {_normal("'7::' || tensor || ':' || row || ':' || col || ':write'")}, -m), m) ELSE v END AS y FROM v, (VALUES (0.005::DOUBLE), (0.02::DOUBLE)) t(sigma))
SELECT subject, sigma, {R6.format('1e6::DOUBLE * avg(pow(y - w, 2))')} AS error FROM d GROUP BY 1, 2""")
def paired_sweep(spark, sf_dir):
    """Two subjects at two noise levels, sharing their noise; one class of tensors only is degraded."""
    w = _w(spark, sf_dir)
    own = layout.digits(w, 63)
    subjects = {"f16": w, "k63": own.select("tensor", "row", F.transform("d", lambda d: grid.dequantize(d, F.col("m"), 63)).alias("v"))}
    out = None
    for name, v in subjects.items():
        for sigma in (0.005, 0.02):
            done = channel.degrade(v, channel.Channel(write_noise=sigma, seed=7)).withColumnRenamed("v", "y").join(v, ["tensor", "row"])
            y = F.when(F.col("tensor") % 2 == 0, F.col("y")).otherwise(F.col("v"))
            both = done.select("tensor", "row", y.alias("y")).join(w, ["tensor", "row"]).select(F.explode(F.arrays_zip("y", "v")).alias("x"))
            one = both.agg(r6(1e6 * F.avg(F.pow(F.col("x.y") - F.col("x.v"), F.lit(2.0))), "error")).select(F.lit(name).alias("subject"), F.lit(sigma).alias("sigma"), "error")
            out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {C}, g AS (SELECT *, w * (1.0::DOUBLE + 0.05::DOUBLE * least(greatest({_normal("'3::' || tensor || ':' || col || ':gain'")}, -4.0), 4.0)) AS g FROM c),
  i AS (SELECT *, 2.0::DOUBLE * greatest(max(abs(g)) OVER (PARTITION BY tensor, row), 1e-8) / 63 AS step FROM g), x AS (SELECT *, round_even(g / step, 0) * step AS x FROM i),
  o AS (SELECT *, x + 0.01::DOUBLE * greatest(max(abs(x)) OVER (PARTITION BY tensor, row), 1e-8) * {_normal("'3::' || tensor || ':' || row || ':' || col || ':out'")} AS y FROM x),
  s AS (SELECT *, 2.0::DOUBLE * greatest(max(abs(y)) OVER (PARTITION BY tensor, row), 1e-8) / 255 AS out_step FROM o)
SELECT tensor, row, col, {R6.format('round_even(y / out_step, 0) * out_step')} AS y FROM s""")
def read_path(spark, sf_dir):
    """Rows as activations: column gains and a 6-bit converter in, noise and an 8-bit converter out."""
    p = channel.Channel(read_noise=0.01, seed=3)
    y = channel.read_out(channel.read_in(_w(spark, sf_dir), p, 0.05, 6), p, 8)
    return y.select("tensor", "row", F.posexplode("v").alias("col", "y")).withColumn("y", F.round("y", 6) + 0.0)


_K = (3, 5, 9, 15, 31, 63)


@query(f"""WITH {M}, r AS (SELECT tensor, row, min(w) AS lo, max(w) AS hi FROM c GROUP BY 1, 2), k AS (SELECT unnest([{', '.join(map(str, _K))}]) AS k),
  e AS (SELECT tensor, k, avg(pow(w - m * (least(greatest(round_even((w + m) * (((k - 1) // 2)::DOUBLE / greatest(m, 1e-30)), 0), 0), k - 1) - (k - 1) // 2) / ((k - 1) // 2)::DOUBLE, 2)) AS a,
    avg(pow(w - (lo + least(greatest(round_even((w - lo) / greatest((hi - lo) / (k - 1), 1e-12), 0), 0), k - 1) * greatest((hi - lo) / (k - 1), 1e-12)), 2)) AS b FROM c JOIN m USING (tensor, row) JOIN r USING (tensor, row), k GROUP BY 1, 2),
  z AS (SELECT k, (SELECT count(*) FROM c) * ceil(log2(k)) / 8 + (SELECT count(*) FROM m) * 4 AS a, (SELECT count(*) FROM c) * ceil(log2(k)) / 8 + (SELECT count(*) FROM m) * 8 AS b FROM k),
  t AS (SELECT x.k AS ka, arg_max(y.k, struct_pack(b := y.b, k := y.k)) AS kb FROM z x JOIN z y ON y.b <= x.a GROUP BY 1)
SELECT ka AS variant, kb AS against, count(*) AS n, {R6.format('1e6::DOUBLE * avg(p.a - q.b)')} AS delta, {R6.format('1e6::DOUBLE * stddev_samp(p.a - q.b) / sqrt(count(*))')} AS se FROM t JOIN e p ON p.k = ka JOIN e q ON q.k = kb AND q.tensor = p.tensor GROUP BY 1, 2""")
def matched_variants(spark, sf_dir):
    """Symmetric grids beside the affine grids of no more bytes, paired by tensor; one scan for all variants."""
    g = layout.grouped(_w(spark, sf_dir)).withColumns({"m": layout.absmax("g"), "lo": F.array_min("g"), "hi": F.array_max("g")})
    def lost(value):
        return F.aggregate("g", F.lit(0.0), lambda s, x: s + F.pow(x - value(x), F.lit(2.0)))

    each = []
    for k in _K:
        for family, value in (("a", lambda x, k=k: grid.dequantize(grid.digit(x, F.col("m"), k), F.col("m"), k)), ("b", lambda x, k=k: grid.affine_value(grid.affine_digit(x, F.col("lo"), F.col("hi"), k), F.col("lo"), F.col("hi"), k))):
            each.append(F.struct(F.lit(family).alias("family"), F.lit(k).alias("variant"), lost(value).alias("e")))
    rows = g.select("tensor", F.size("g").alias("n"), F.explode(F.array(*each)).alias("x")).groupBy("tensor", "x.family", "x.variant").agg(F.sum("x.e").alias("e"), F.sum("n").alias("n"), F.count("*").alias("scales"))
    bits = F.ceil(F.log2(F.col("variant")))
    size = F.sum("n") * bits / 8 + F.sum("scales") * F.when(F.col("family") == "a", 4).otherwise(8)
    sizes = rows.groupBy("family", "variant").agg(size.alias("bytes"))
    m = cost.matched(rows.select("family", "variant", F.col("tensor").alias("window"), (F.col("e") / F.col("n")).alias("x")), sizes)
    return m.select("variant", "against", "n", r6(1e6 * F.col("delta"), "delta"), r6(1e6 * F.col("se"), "se"))


@query(f"""WITH {C}, i AS (SELECT tensor, col, 1.0::DOUBLE + sqrt(avg(w * w)) AS imp FROM c WHERE tensor % 3 <> 0 GROUP BY 1, 2), x AS (SELECT c.*, coalesce(imp, 1.0) AS imp FROM c LEFT JOIN i USING (tensor, col)),
  m AS (SELECT tensor, row, max(abs(w) * imp) AS m FROM x GROUP BY 1, 2) SELECT tensor, row, {R6.format('m')} AS m, sum(least(greatest(round_even((w + m) * (7.0::DOUBLE / greatest(m, 1e-30)), 0), 0), 14))::BIGINT AS digits FROM x JOIN m USING (tensor, row) GROUP BY tensor, row, m""")
def weighted_scales(spark, sf_dir):
    """Scales from magnitudes times each column's importance (one more than its root mean square); a third of the tensors has none."""
    w = _w(spark, sf_dir)
    c = layout.cells(w.where("tensor % 3 <> 0")).groupBy("tensor", "col").agg((1.0 + F.sqrt(F.avg(F.col("w") * F.col("w")))).alias("i"))
    imp = c.groupBy("tensor").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "i"))), lambda x: x["i"]).alias("imp"))
    d = layout.weighted_digits(w, imp, 15)
    return d.select("tensor", "row", r6(F.col("m"), "m"), F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x).alias("digits"))


@query("WITH n AS (SELECT label AS tensor, vec_id AS row, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT tensor, row, i // 16 AS page, i % 16 AS at FROM n")
def row_pages(spark, sf_dir):
    """Rows of a tensor in pages of sixteen."""
    return layout.pages(_w(spark, sf_dir), 16).select("tensor", "row", F.col("page").cast("long").alias("page"), F.col("at").cast("long").alias("at"))


_PARTS = "CASE WHEN label = 0 THEN 'embed' WHEN label = 1 THEN 'rest' ELSE 'body' END"


@query(f"WITH p AS (SELECT {_PARTS} AS part, count(*) * 64 AS n, count(*) AS s FROM embeddings GROUP BY 1), v AS (SELECT part, CASE WHEN part = 'rest' THEN n * 4.0::DOUBLE ELSE n * CASE WHEN part = 'body' THEN 3.1::DOUBLE ELSE 6.6::DOUBLE END / 8 + s * 4 END AS b FROM p) SELECT {', '.join(R6.format(f'coalesce(sum(b) FILTER (part = {x!r}), 0)') + f' AS {x}' for x in ('body', 'embed', 'rest'))}, {R6.format('sum(b)')} AS total FROM v")
def model_bytes(spark, sf_dir):
    """A model's bytes: body, table and rest."""
    part = F.when(F.col("tensor") == 0, "embed").when(F.col("tensor") == 1, "rest").otherwise("body")
    p = _w(spark, sf_dir).groupBy(part.alias("part")).agg(F.sum(F.size("v")).alias("n"), F.count("*").alias("scales")).withColumn("bits", F.when(F.col("part") == "body", 3.1).otherwise(6.6))
    b = cost.model_bytes(p)
    return b.select(*[r6(F.col(c), c) for c in b.columns])


@query(f"""WITH p AS (SELECT l_linenumber AS curve, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem WHERE l_quantity % 7 = 0 GROUP BY 1, 2), q AS (SELECT DISTINCT l_linenumber AS curve, l_quantity AS x FROM lineitem),
  b AS (SELECT q.curve, q.x, max_by(p.x, p.x) FILTER (p.x <= q.x) AS x0, max_by(p.y, p.x) FILTER (p.x <= q.x) AS y0, min_by(p.x, p.x) FILTER (p.x > q.x) AS x1, min_by(p.y, p.x) FILTER (p.x > q.x) AS y1 FROM q JOIN p ON p.curve = q.curve GROUP BY 1, 2)
SELECT curve, x, {R6.format('CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END')} AS y FROM b""")
def rate_between(spark, sf_dir):
    """Values on the broken line through a few measured points of each curve, level beyond its ends."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("curve"), F.col("l_quantity").alias("x"), "l_extendedprice")
    p = line.where("x % 7 = 0").groupBy("curve", "x").agg(F.avg("l_extendedprice").alias("y")).groupBy("curve").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))
    return line.select("curve", "x").distinct().join(p, "curve").select("curve", "x", r6(cost.interpolated(F.col("x"), F.col("points")), "y"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 3 = 2 AND NOT contains(p_name, 'anvil') AND p_size * round(p_retailprice)::BIGINT >= 4096")
def selected_layers(spark, sf_dir):
    """Matrices of a catalogue that are large enough and aren't excluded by name."""
    return layout.selected(table(spark, sf_dir, "part").withColumns({"rank": F.col("p_size") % 3, "elements": F.col("p_size") * F.round("p_retailprice").cast("long")}), "p_name", exclude="anvil").select("p_partkey", "p_name")


@query("SELECT s.s_suppkey, s.s_name, n.n_name, row_number() OVER (ORDER BY s.s_suppkey) AS place FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE n.n_regionkey < 3")
def manifest_order(spark, sf_dir):
    """A manifest's rows that a reference has, numbered in the reference's order (both have a row a tensor)."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", "s_name", "n_name", F.row_number().over(Window.orderBy("s_suppkey")).alias("place"))


@query(f"WITH {C}, p AS (SELECT tensor, row, col, w::FLOAT AS a, (w + w * 3e-7)::FLOAT AS b FROM c) SELECT tensor, {R6.format('max(abs(a::DOUBLE - b::DOUBLE) / greatest(abs(a::DOUBLE), 1e-30) / 1.19e-7::DOUBLE)')} AS ulps FROM p GROUP BY 1")
def largest_ulps(spark, sf_dir):
    """The largest difference of two vectors in units of the last place of single precision, by tensor."""
    c = layout.cells(_w(spark, sf_dir)).select("tensor", F.col("w").cast("float").cast("double").alias("a"), (F.col("w") + F.col("w") * 3e-7).cast("float").cast("double").alias("b"))
    return c.groupBy("tensor").agg(r6(F.max(F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.lit(1e-30)) / 1.19e-7), "ulps"))


def _le(x: str, size: int) -> str:
    wide = f"printf('%0{2 * size}X', {x})"
    return " || ".join(f"substr({wide}, {2 * (size - k) - 1}, 2)" for k in range(size))


_REC = "s_name AS name, s_suppkey AS r, s_suppkey * 64 AS c, s_nationkey * 2 + 3 AS k, s_suppkey % 20 AS lanes, s_suppkey * 3 AS dig"


def _tensors(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = lambda x, name: x.cast("long").alias(name)
    return s.select(
        F.col("s_name").alias("name"), n(F.col("s_suppkey"), "rows"), n(F.col("s_suppkey") * 64, "cols"), n(F.col("s_nationkey") * 2 + 3, "k"), n(F.lit(64), "group"), n(F.lit(2), "mode"), n(F.lit(0), "perm"),
        n(F.col("s_suppkey") % 20, "lanes"), n(F.lit(126), "tbl"), n(F.col("s_suppkey") * 3, "dig"), n(F.lit(300_000), "sca"), n(F.lit(0), "plen"), n(F.col("s_suppkey") + 1, "page_rows"),
    )


@query(f"""WITH s AS (SELECT {_REC} FROM supplier), n AS (SELECT printf('%04X', count(*)) AS h FROM s), p AS (SELECT printf('%04X', count(*)) AS h FROM s WHERE lanes > 1),
  d AS (SELECT string_agg({_le('octet_length(encode(name))', 2)} || hex(encode(name)) || '02' || {_le('r', 4)} || {_le('c', 4)} || {_le('k', 1)} || '400200' || {_le('lanes', 1)} || '7E000000' || {_le('dig', 4)} || 'E0930400' || '00000000', '' ORDER BY r) AS h FROM s),
  g AS (SELECT string_agg({_le('octet_length(encode(name))', 2)} || hex(encode(name)) || {_le('lanes', 1)} || {_le('r + 1', 4)}, '' ORDER BY r) AS h FROM s WHERE lanes > 1)
SELECT 'directory' AS kind, '0200' || substr(n.h, 3, 2) || substr(n.h, 1, 2) || d.h AS bytes FROM n, d UNION ALL SELECT 'pages', '0100' || substr(p.h, 3, 2) || substr(p.h, 1, 2) || g.h FROM p, g""")
def directory_bytes(spark, sf_dir):
    """A model's directory and page table as bytes."""
    t = _tensors(spark, sf_dir)
    d = directory.build_directory(t, "rows").select(F.lit("directory").alias("kind"), F.hex("bytes").alias("bytes"))
    return d.unionByName(directory.build_pages(t, "rows").select(F.lit("pages").alias("kind"), F.hex("bytes").alias("bytes")))


@query(f"WITH s AS (SELECT {_REC} FROM supplier) SELECT f.file, row_number() OVER (PARTITION BY f.file ORDER BY r) - 1 AS position, name, r AS rows, c AS cols, k, CASE WHEN f.file = 'old' THEN 1 ELSE lanes END AS lanes, dig, 300000 AS sca FROM s, (VALUES ('new'), ('old')) f(file)")
def directory_records(spark, sf_dir):
    """Directories of both versions read back; where a file has both keys the newer one counts."""
    ship(spark)
    t = _tensors(spark, sf_dir)
    new, old = directory.build_directory(t, "rows"), directory.build_directory(t, "rows", 1)
    both = new.crossJoin(old.withColumnRenamed("bytes", "older")).select(F.lit("new").alias("file"), F.create_map(F.lit("k9.directory"), F.col("older"), F.lit("ninths.directory2"), F.col("bytes")).alias("keys"))
    one = old.select(F.lit("old").alias("file"), F.create_map(F.lit("ninths.directory"), F.col("bytes")).alias("keys"))
    none = spark.createDataFrame([("empty",)], "file string").withColumn("keys", F.expr("cast(map() as map<string, binary>)"))
    return directory.read_directories(both.unionByName(one).unionByName(none)).select("file", "position", "name", "rows", "cols", "k", "lanes", "dig", "sca")


@query("SELECT s_name AS name, s_suppkey % 20 AS lanes, s_suppkey + 1 AS page_rows FROM supplier WHERE s_suppkey % 20 > 1")
def page_table(spark, sf_dir):
    ship(spark)
    return directory.read_pages(directory.build_pages(_tensors(spark, sf_dir), "rows").withColumn("file", F.lit("x"))).select("name", "lanes", "page_rows")


@query(f"WITH {C} SELECT tensor::VARCHAR AS file, row::VARCHAR AS key, count(*)::INT AS n, {R6.format('sum(w)')} AS total FROM c GROUP BY 1, 2")
def arrays_files(spark, sf_dir):
    """Each tensor's rows as an arrays file, read back by a pattern of names."""
    ship(spark)
    w = _w(spark, sf_dir).select(F.col("tensor").cast("string").alias("file"), F.concat(F.lit("row_"), F.col("row").cast("string")).alias("name"), "v")
    back = directory.read_arrays(directory.write_arrays(w, "file", "name", "v"), r"row_(\d+)")
    return back.select("file", "key", F.size("values").alias("n"), r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), "total"))


@query(f"""WITH {C}, b AS (SELECT tensor, row, col // 32 AS block, max(abs(w::FLOAT)) / 127::FLOAT AS d0 FROM c GROUP BY 1, 2, 3), h AS (SELECT *, pow(2.0::DOUBLE, greatest(floor(log2(greatest(d0::DOUBLE, 1e-30))), -14) - 10) AS u FROM b), e AS (SELECT *, round_even(d0::DOUBLE / u, 0) * u AS d FROM h)
SELECT c.tensor, c.row, 68 AS bytes, sum(greatest(least(round_even((w::FLOAT / d0)::DOUBLE, 0), 127), -127))::BIGINT AS codes, {R6.format('sum(greatest(least(round_even((w::FLOAT / d0)::DOUBLE, 0), 127), -127) * d)')} AS total FROM c JOIN e ON e.tensor = c.tensor AND e.row = c.row AND e.block = c.col // 32 GROUP BY 1, 2""")
def eights_blocks(spark, sf_dir):
    """Blocks of 32 8-bit codes with a half-precision scale, packed and unpacked."""
    ship(spark)

    def run(frames):
        for f in frames:
            out = []
            for t, r, v in zip(f["tensor"], f["row"], f["v"]):
                blob = packing.pack_eights(np.asarray(v))
                codes = np.frombuffer(blob, np.uint8).reshape(-1, 34)[:, 2:].copy().view(np.int8)
                out.append((t, r, len(blob), int(codes.astype(int).sum()), float(packing.unpack_eights(blob).astype(float).sum())))
            yield pd.DataFrame(out, columns=["tensor", "row", "bytes", "codes", "total"])

    made = _w(spark, sf_dir).mapInPandas(run, "tensor int, row long, bytes int, codes long, total double")
    return made.select("tensor", "row", "bytes", "codes", r6(F.col("total"), "total"))


@query("SELECT event_id, (event_id * 2654435761) % 65536 AS bits, CASE WHEN ((event_id * 2654435761) % 65536) // 128 % 256 BETWEEN 1 AND 254 THEN CASE WHEN (event_id * 2654435761) % 65536 >= 32768 THEN -1.0::DOUBLE ELSE 1.0 END * (128 + (event_id * 2654435761) % 128) END AS mantissa FROM events")
def widened_floats(spark, sf_dir):
    """16-bit brain floats widened to single precision; shown by sign and mantissa in 128ths."""
    ship(spark)

    def run(frames):
        for f in frames:
            x = packing.widen_bf16(f["bits"].to_numpy()).astype(np.float64)
            fraction, _ = np.frexp(x)
            yield pd.DataFrame({"event_id": f["event_id"], "bits": f["bits"], "mantissa": np.where(np.isfinite(x) & (np.abs(x) >= 2.0**-126), fraction * 256, np.nan)})

    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 2654435761) % 65536).alias("bits"))
    return e.mapInPandas(run, "event_id long, bits long, mantissa double").withColumn("mantissa", F.nanvl("mantissa", F.lit(None).cast("double")))


@query("""WITH RECURSIVE e AS (SELECT user_id, value::FLOAT AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS i FROM events), f(user_id, i, s) AS (SELECT user_id, i, x FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, (f.s + e.x)::FLOAT FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, max(i)::INT AS n, round(max_by(s, i)::DOUBLE, 6) + 0.0 AS last, round(sum(s::DOUBLE), 6) + 0.0 AS total FROM f GROUP BY 1""")
def chained_sums(spark, sf_dir):
    """Single-precision running sums, started anew with each case."""
    s = fits.chained_sums(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return s.select("user_id", "n", r6(F.element_at("sums", -1).cast("double"), "last"), r6(F.aggregate("sums", F.lit(0.0), lambda a, x: a + x.cast("double")), "total"))
