"""Queries over coded streams, fitted grids and sequential folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import numtheory, packing, rans
from gridloom.operators import codec, corpus, cost, fits, layout
from gridloom.plans.quantization import C, D, M, _w, R6
from gridloom.plans.registry import query, r6, table
from gridloom.shipping import ship


@query(f"WITH {D(9)}, l AS (SELECT tensor, row, col, d, (dense_rank() OVER (PARTITION BY tensor ORDER BY row) - 1) // 64 AS lane FROM d) SELECT tensor, lane::BIGINT AS lane, count(*)::INT AS n, md5(string_agg(d, '' ORDER BY row, col)) AS digits FROM l GROUP BY 1, 2")
def lanes_round_trip(spark, sf_dir):
    """Digits coded in lanes and decoded again: all of each lane's digits, as a digest."""
    ship(spark)
    back = codec.decode_lanes(codec.encode_lanes(layout.digits(_w(spark, sf_dir), 9), 9))
    return back.select("tensor", "lane", F.size("d").alias("n"), F.md5(F.array_join(F.transform("d", lambda x: x.cast("string")), "").cast("binary")).alias("digits"))


@query(f"WITH {D(9)}, l AS (SELECT tensor, d, (dense_rank() OVER (PARTITION BY tensor ORDER BY row) - 1) // 64 AS lane FROM d) SELECT tensor, lane::BIGINT AS lane, count(*)::INT AS n, true AS near FROM l GROUP BY 1, 2")
def coded_rate(spark, sf_dir):
    """Whether each lane's stream, its end state counted, takes what its table says: the digits' cross entropy, and at most 32 bits and one part in a hundred more."""
    d = layout.digits(_w(spark, sf_dir), 9)
    lanes = codec.encode_lanes(d, 9)
    back = codec.decode_lanes(lanes).select("tensor", "lane", F.explode("d").alias("s")).groupBy("tensor", "lane", "s").agg(F.count("*").alias("c"))
    both = back.join(lanes.select("tensor", "lane", "n", "freqs", "stream"), ["tensor", "lane"])
    bits = both.groupBy("tensor", "lane", "n", F.octet_length("stream").alias("size")).agg(F.sum(F.col("c") * (F.log2(F.lit(float(codec.TOTAL))) - F.log2(F.col("freqs")[F.col("s")].cast("double")))).alias("h"))
    used = 8.0 * F.col("size")
    return bits.select("tensor", "lane", "n", ((used >= F.col("h")) & (used <= F.col("h") * 1.01 + 40)).alias("near"))


@query(f"WITH {D(9)} SELECT tensor, row, string_agg(d, '' ORDER BY col) AS digits FROM d GROUP BY 1, 2")
def nine_round_trip(spark, sf_dir):
    """Each row's digits coded in base 9, packed in bytes, and read back."""
    ship(spark)

    def run(frames):
        for f in frames:
            out = []
            for t, r, d in zip(f["tensor"], f["row"], f["d"]):
                made = rans.Table.of(d, 9, rans.NINE_TOTAL)
                digits, state = rans.encode_nine(d, made)
                back = rans.decode_nine(rans.unpack_nine(rans.pack_nine(digits), len(digits)), state, len(d), made)
                out.append((t, r, "".join(map(str, back))))
            yield pd.DataFrame(out, columns=["tensor", "row", "digits"])

    return layout.digits(_w(spark, sf_dir), 9).select("tensor", "row", "d").mapInPandas(run, "tensor int, row long, digits string")


@query("SELECT vec_id // 4 AS block, count(*)::INT AS rows, 200 AS bytes, true AS same FROM embeddings GROUP BY 1")
def blocks_round_trip(spark, sf_dir):
    """Four rows make a block of 256 codes (the last may be filled up with the middle code); packed, unpacked and compared."""
    ship(spark)
    d = layout.digits(_w(spark, sf_dir), 63).withColumn("b", F.floor(F.col("row") / 4))
    g = d.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("row", "m", "d"))).alias("rs"))

    def run(frames):
        for f in frames:
            out = []
            for b, rs in zip(f["b"], f["rs"]):
                digits = np.full((4, 64), 31)
                scales = np.zeros(4)
                for k, r in enumerate(rs):
                    digits[k], scales[k] = r["d"], r["m"]
                blob = packing.pack_blocks(digits.reshape(1, 256), 63, scales.reshape(1, 4))
                _, codes, _ = packing.unpack_blocks(blob, 1, 256, "b6")
                out.append((b, len(rs), len(blob), bool((codes + 31 == digits.reshape(1, 256)).all())))
            yield pd.DataFrame(out, columns=["block", "rows", "bytes", "same"])

    return g.mapInPandas(run, "block long, rows int, bytes int, same boolean")


@query()
def fitted_grids(spark, sf_dir):
    return fits.fitted_rows(_w(spark, sf_dir), 9).select("tensor", "row", F.array_distinct("d").alias("used"), F.size("centres").alias("k"))


@query()
def compensated_rows(spark, sf_dir):
    w = _w(spark, sf_dir)
    return fits.compensated(w, fits.gram_matrix(w), 9).select("tensor", "row", "d")


_FEED_M = "pow(2.0::DOUBLE, greatest(floor(log2(greatest(m, 1e-30))), -14) - 10)"
_FEED_Q = "m * (least(greatest(round_even((w + 0.5::DOUBLE * carry) / m * 7 + 7, 0), 0), 14) - 7) / 7"


@query(f"""WITH RECURSIVE {C}, x AS (SELECT row // 4 AS r, row % 4 AS b, col, w FROM c), g0 AS (SELECT r, b, max(abs(w)) AS m FROM x GROUP BY 1, 2), g AS (SELECT r, b, round_even(m / {_FEED_M}, 0) * {_FEED_M} AS m FROM g0),
  y AS (SELECT x.*, CASE WHEN m = 0 THEN 1 ELSE m END AS m FROM x JOIN g USING (r, b)),
  f(r, b, col, q, carry) AS (SELECT r, b, col, {_FEED_Q}, w - {_FEED_Q} FROM (SELECT *, 0.0::DOUBLE AS carry FROM y WHERE b = 0) UNION ALL SELECT r, b, col, {_FEED_Q}, w - {_FEED_Q} FROM (SELECT y.*, f.carry FROM f JOIN y ON y.r = f.r AND y.col = f.col AND y.b = f.b + 1))
SELECT r AS row, count(*)::INT AS n, {R6.format('sum(q)')} AS total, {R6.format('sum(q * (64 * b + col))')} AS moment FROM f GROUP BY 1""")
def fed_back_rows(spark, sf_dir):
    """Four vectors make a row of 256; each group of 64 takes up half of what the group before it lost."""
    wide = _w(spark, sf_dir).groupBy(F.floor(F.col("row") / 4).alias("row")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("row").alias("r"), "v"))), lambda x: x["v"])).alias("v"))
    q = fits.with_feedback(wide.withColumn("tensor", F.lit(0)), 15, feedback=0.5)
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(F.transform("q", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return q.select("row", F.size("q").alias("n"), r6(total, "total"), r6(moment, "moment"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id, value) AS i FROM events),
  f(user_id, i, n, v) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0.0::DOUBLE FROM e UNION ALL SELECT e.user_id, e.i, n + (v * 0.9::DOUBLE + value >= 100)::INT, CASE WHEN v * 0.9::DOUBLE + value >= 100 THEN 0 ELSE v * 0.9::DOUBLE + value END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, max_by(n, i) AS spikes, round(max_by(v, i), 6) + 0.0 AS charge FROM f GROUP BY 1""")
def leaky_spikes(spark, sf_dir):
    return fits.leaky_fold(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "spikes", r6(F.col("charge"), "charge"))


@query("SELECT l_suppkey % 100 + 2 AS q, count(*) AS n FROM lineitem GROUP BY 1")
def fraction_moduli(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 100 + 2).alias("q")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey % 100 + 2 AS q, unnest([9, 10]) AS base FROM lineitem), r(q, base, i, rem, digits) AS (SELECT q, base, 0, 1::BIGINT, '' FROM p UNION ALL SELECT q, base, i + 1, rem * base % q, digits || (rem * base // q) FROM r WHERE i < 205 AND rem > 0),
  f AS (SELECT q, base, rem, min(i) AS i0, min(i) FILTER (i > (SELECT min(i) FROM r x WHERE x.q = r.q AND x.base = r.base AND x.rem = r.rem)) AS i1, max(digits) AS digits FROM r GROUP BY 1, 2, 3),
  e AS (SELECT q, base, coalesce(min(i0) FILTER (rem = 0), min(i0) FILTER (i1 IS NOT NULL)) AS lead, CASE WHEN bool_or(rem = 0) THEN 0 ELSE min(i1 - i0) FILTER (i1 IS NOT NULL) END AS period, max(digits) AS digits FROM f GROUP BY 1, 2)
SELECT q, base, lead, period, '0.' || substr(digits, 1, lead) || CASE WHEN period > 0 THEN '(' || substr(digits, lead + 1, period) || ')' ELSE '' END AS printed, true AS exact FROM e""")
def repeating_expansions(spark, sf_dir):
    """The expansions in bases 9 and 10 of 1/q."""
    ship(spark)

    def run(frames):
        for f in frames:
            out = []
            for q in f["q"]:
                for base in (9, 10):
                    lead, period = numtheory.expand(1, int(q), base)
                    exact = numtheory.value(base, lead, period)
                    out.append((q, base, len(lead), len(period), numtheory.printed(lead, period), exact.numerator == 1 and exact.denominator == q))
            yield pd.DataFrame(out, columns=["q", "base", "lead", "period", "printed", "exact"])

    return fraction_moduli(spark, sf_dir).select("q").mapInPandas(run, "q long, base int, lead int, period int, printed string, exact boolean")


@query("""WITH x AS (SELECT p_partkey AS k, p_retailprice % 1 AS x FROM part), c AS (SELECT k, x, q, round(x * q)::INT AS p, abs(x - round(x * q) / q) AS e FROM x, range(1, 65) t(q)),
  b AS (SELECT k, arg_min(p, struct_pack(e := round(e, 12), q := q)) AS p, arg_min(q, struct_pack(e := round(e, 12), q := q)) AS q FROM c GROUP BY 1)
SELECT k, p, q::INT AS q, (greatest(1, length(bin(p))) + length(bin(q)))::INT AS bits FROM b""")
def near_fractions(spark, sf_dir):
    ship(spark)

    def run(frames):
        for f in frames:
            got = [numtheory.best_rational(float(x), 64) for x in f["x"]]
            yield pd.DataFrame({"k": f["k"], "p": [g[0] for g in got], "q": [g[1] for g in got], "bits": [g[2] for g in got]})

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") % 1).alias("x")).mapInPandas(run, "k long, p int, q int, bits int")


@query(f"WITH {M}, e AS (SELECT tensor, var_pop(w) * count(*) AS e, count(*) AS n FROM c GROUP BY 1) SELECT tensor, n, {R6.format('e')} AS total FROM e")
def allocation_inputs(spark, sf_dir):
    c = layout.cells(_w(spark, sf_dir))
    return c.groupBy("tensor").agg(F.count("*").alias("n"), r6(F.var_pop("w") * F.count("*"), "total"))


@query()
def level_allocation(spark, sf_dir):
    """Levels for each tensor under a byte budget."""
    w, parts = _w(spark, sf_dir), None
    from gridloom.functions import grid

    for k in (9, 15, 63):
        d = layout.digit_cells(w, k)
        err = d.groupBy("tensor").agg(F.sum(F.pow(F.col("w") - grid.dequantize(F.col("d"), F.col("m"), k), F.lit(2.0))).alias("err"))
        one = cost.tensor_cost(d, k).join(err, "tensor").select("tensor", F.lit(k).alias("k"), "bytes", "err")
        parts = one if parts is None else parts.unionByName(one)
    low = {r.tensor: r.b for r in parts.where("k = 9").select("tensor", F.col("bytes").alias("b")).collect()}
    levels = cost.allocate(parts, 1.3 * sum(low.values()), 9)
    return spark.createDataFrame(sorted((int(t), int(k)) for t, k in levels.items()), "tensor int, k int")


@query("SELECT source AS name, '4.1' AS version, doc_id || '.txt' AS path, 'text' AS lang, length(text)::INT AS chars, md5(text) AS content FROM documents WHERE NOT regexp_matches(text, '(?m)^(```|File name:|### Files:)') UNION ALL SELECT source, '4.1', 'empty.gd', 'gdscript', 0, md5('') FROM documents WHERE NOT regexp_matches(text, '(?m)^(```|File name:|### Files:)')")
def parsed_dumps(spark, sf_dir):
    """Each document wrapped as a project dump, and parsed again: a file, one without a block, an empty one, one that comes twice."""
    d = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(?md)^(```|File name:|### Files:)"))
    dump = F.concat(
        F.lit("### Name: old\n### Name:  "), "source", F.lit(" \n### Godot version: 4.1\n### Files:\n\nFile name: "), F.col("doc_id").cast("string"), F.lit(".txt\n```\nfirst\n```\nFile name: none.gd\nplain\nFile name: empty.gd\n\n  \n```gdscript\n```\nFile name: "),
        F.col("doc_id").cast("string"), F.lit(".txt \n\n```text\n"), "text", F.lit("\n```\n"),
    )
    return corpus.parse_dumps(d.select(dump.alias("value"))).select("name", "version", "path", "lang", F.length("content").alias("chars"), F.md5(F.col("content").cast("binary")).alias("content"))