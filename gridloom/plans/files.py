"""Queries that write files or containers and read them again, and counts over a corpus."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.functions import text as T
from gridloom.operators import channel, corpus, cost, layout, stats
from gridloom.plans.quantization import C, D, M, R6, _w
from gridloom.plans.registry import query, r6, table
from gridloom.shipping import ship
from gridloom.sources import container, files, work

#: Bytes of text in a shard, about; shards are ranges of as many rows each.
SHARD = 32 << 20


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def rows_in_order(spark, sf_dir):
    """Documents in the order of their shards and rows; numbers by ranges of rows, so no task holds a shard.

    A shard is written by one task, so their number follows the texts' bytes.
    """
    path = work.fresh(spark, "shards")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    d.repartitionByRange(max(3, -(-size // SHARD)), "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    rows = files.in_order(files.parquet_columns(spark, path, ["doc_id", "not_there"])).withColumnRenamed("file", "tensor")
    numbered = layout.pages(rows, 1 << 40).withColumn("i", F.col("at"))
    sizes = rows.groupBy("tensor").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("tensor").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(sizes, "tensor").select("doc_id", (F.col("before") + F.col("i")).cast("long").alias("place"))


@query("SELECT source || '::' || doc_id || '.txt' AS id, text FROM documents")
def json_lines(spark, sf_dir):
    """Rows written as JSON lines and read back."""
    path = work.fresh(spark, "jsonl")
    d = table(spark, sf_dir, "documents")
    files.write_jsonl(d.select(F.concat("source", F.lit("::"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("id"), "text"), path)
    return files.jsonl(spark, path, "id string, text string").where("_corrupt_record is null").select("id", "text")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def appended_results(spark, sf_dir):
    """Two results appended to one CSV folder in a fixed column order, read as one table."""
    path = work.fresh(spark, "csv")
    o = table(spark, sf_dir, "orders")
    for c in ("o_orderpriority", "o_orderstatus"):
        files.append_csv(o.groupBy(F.col(c).alias("priority")).agg(F.count("*").alias("n")).select("n", "priority"), path, ["priority", "n"])
    return spark.read.schema("priority string, n long").csv(path, header=True)


@query("SELECT event_id AS line, event_id * 7 AS word, CASE WHEN event_id % 3 = 0 THEN 'v' ELSE 'p' END AS kind, event_id % 8 AS tap, round(value, 3) AS value FROM events WHERE event_id % 5 < 4 AND event_id % 11 > 0")
def captured_lines(spark, sf_dir):
    """Probe lines among noise, hexadecimal words and log fields of the same events, each read by its own reader and joined."""
    e = table(spark, sf_dir, "events")
    ok, named = F.col("event_id") % 5 < 4, F.col("event_id") % 11 > 0
    paths = {k: work.fresh(spark, k) for k in ("probe", "hex", "log")}
    v = F.format_string("%.3f", F.round("value", 3))
    e.select(F.when(ok, F.concat(F.when(F.col("event_id") % 3 == 0, "v").otherwise("p"), F.lit(","), F.col("event_id").cast("string"), F.lit(","), v)).otherwise("noise,x")).write.text(paths["probe"])
    e.select(F.concat(F.lower(F.lpad(F.hex(F.col("event_id") * 7), 8, "0")), F.lit(" // word"))).write.text(paths["hex"])
    e.where(named).select(F.concat(F.lit("at 1 tap = "), F.col("event_id").cast("string"), F.lit(" ok"))).write.text(paths["log"])
    probe = files.probe_lines(spark, paths["probe"]).select(F.col("tap").cast("long").alias("line"), "kind", "value")
    words = files.hex_words(spark, paths["hex"]).select((F.col("word") / 7).cast("long").alias("line"), "word")
    logs = files.matched_fields(spark, paths["log"], {"tap": r"tap = (\d+)"}).select(F.col("value").cast("long").alias("line"))
    return probe.join(words, "line").join(logs, "line").select("line", "word", "kind", (F.col("line") % 8).alias("tap"), "value")


@query("SELECT source AS name, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS value FROM documents WHERE NOT contains(text, chr(13)) GROUP BY 1")
def whole_files(spark, sf_dir):
    """A text file a source, each read whole."""
    path = work.fresh(spark, "texts")
    d = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\r"))).select("source", "doc_id", "text")
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    read = files.whole_texts(spark, f"{path}/*/*.txt")
    return read.select(F.regexp_extract("path", r"source=([^/]*)/", 1).alias("name"), "value")


@query("SELECT doc_id, octet_length(encode(text)) AS plain, true AS smaller, true AS same FROM documents WHERE length(text) > 2000")
def packed_sizes(spark, sf_dir):
    """Texts as a general compressor packs them: the probe that coded sizes are held against."""

    def run(frames):
        for f in frames:
            raw = [t.encode() for t in f["text"]]
            made = [gzip.compress(r, 9, mtime=0) for r in raw]
            yield pd.DataFrame({"doc_id": f["doc_id"], "plain": [len(r) for r in raw], "smaller": [len(m) < len(r) for m, r in zip(made, raw)], "same": [gzip.decompress(m) == r for m, r in zip(made, raw)]})

    d = table(spark, sf_dir, "documents").where(F.length("text") > 2000).select("doc_id", "text")
    return d.mapInPandas(run, "doc_id long, plain long, smaller boolean, same boolean")


def _containers(spark, sf_dir):
    """(path, content): a container of four tensors for each tensor of the table, made of its rows; a container is one artefact, made in one task."""
    ship(spark)
    d = layout.digits(_w(spark, sf_dir), 15).select("tensor", "row", "m", "d")

    def run(key, frame):
        frame = frame.sort_values("row")
        made = []
        for k in range(4):
            part = frame[frame["row"] % 4 == k]
            if len(part):
                digits = np.stack(list(part["d"])).reshape(-1)
                made.append({"name": f"layer.{k}.weight", "shape": [len(part), 64], "k": 15, "group": 64, "mode": "fp32" if k % 2 else "fp16", "digits": digits, "scales": part["m"].to_numpy(), "perm": np.arange(63, -1, -1) if k == 3 else None})
        return pd.DataFrame({"path": [f"{key[0]}.bin"], "content": [container.write(made)]})

    return d.groupBy("tensor").applyInPandas(run, "path string, content binary")


_PARTS = f"WITH {D(15)}, r AS (SELECT tensor, row, row % 4 AS part, string_agg(d, ',' ORDER BY col) AS ds, any_value(m) AS m FROM d GROUP BY 1, 2)"


@query(f"{_PARTS} SELECT tensor || '.bin' AS path, 'layer.' || part || '.weight' AS name, count(*) AS rows, 64 AS cols, 15 AS k, CASE WHEN part % 2 = 1 THEN 'fp32' ELSE 'fp16' END AS mode, true AS chained FROM r GROUP BY tensor, part")
def container_directories(spark, sf_dir):
    """Directories of containers, and whether each blob starts where the one before it ends."""
    d = container.directories(_containers(spark, sf_dir))
    ends = F.lag(F.expr("off + tbl + dig + sca + plen")).over(Window.partitionBy("path").orderBy("off"))
    return d.withColumn("chained", F.coalesce(ends == F.col("off"), F.lit(True))).select("path", "name", F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("cols"), "k", "mode", "chained")


@query(f"{_PARTS} SELECT tensor || '.bin' AS path, 'layer.' || part || '.weight' AS name, md5(string_agg(ds, ',' ORDER BY row)) AS digits, count(*)::INT AS scales, round(sum(m::FLOAT::DOUBLE), 4) + 0.0 AS total, CASE WHEN part = 3 THEN 2016 END AS perm FROM r WHERE part IN (1, 3) GROUP BY tensor, part")
def container_tensors(spark, sf_dir):
    """Two tensors of each container by name, from a table of blobs: the filter reaches the scan, the other blobs aren't read."""
    path = work.fresh(spark, "blobs")
    container.blobs(_containers(spark, sf_dir)).write.parquet(path)
    rows = spark.read.parquet(path).where(F.col("name").isin("layer.1.weight", "layer.3.weight"))
    d = container.decoded(rows)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    text = F.array_join(F.transform("digits", lambda x: x.cast("string")), ",")
    return d.select("path", "name", F.md5(text.cast("binary")).alias("digits"), F.size("scales").alias("scales"), (F.round(add(F.transform("scales", lambda x: x.cast("double"))), 4) + 0.0).alias("total"), F.when(F.col("perm").isNotNull(), add(F.transform("perm", lambda x: x.cast("double")))).cast("long").alias("perm"))


@query(f"WITH {D(15)} SELECT 'layer' || tensor AS name, (dense_rank() OVER (PARTITION BY tensor ORDER BY row) - 1)::INT AS row, round(any_value(m), 6) + 0.0 AS scale, string_agg(d, ',' ORDER BY col) AS digits FROM d GROUP BY tensor, row")
def printed_models(spark, sf_dir):
    """Layers printed one after another with headers, a file for every five, and read back."""
    path = work.fresh(spark, "printed")
    d = layout.digits(_w(spark, sf_dir), 15)
    line = F.concat(F.lit("m="), F.col("m").cast("string"), F.lit(" | "), F.array_join(F.transform("d", lambda x: F.concat(F.lit("0.("), x.cast("string"), F.lit(")"))), ""))
    head = d.groupBy("tensor").agg(F.count("*").alias("n")).select("tensor", F.lit(-1).cast("long").alias("row"), F.concat(F.lit("LAYER layer"), F.col("tensor").cast("string"), F.lit(" tr=0 rows="), F.col("n").cast("string"), F.lit(" cols=64")).alias("value"))
    body = d.select("tensor", "row", line.alias("value")).unionByName(head).withColumn("part", F.floor(F.col("tensor") / 5))
    body.repartition("part").sortWithinPartitions("part", "tensor", "row").select("part", "value").write.partitionBy("part").text(path)
    p = files.printed_layers(spark, f"{path}/*/*.txt")
    return p.select("name", "row", r6(F.col("scale"), "scale"), F.array_join("digits", ",").alias("digits"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, (o_totalprice / 100)::BIGINT AS n FROM orders), p AS (SELECT *, coalesce(sum((n + 31) // 32 * 32) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM s)
SELECT o_custkey AS file, o_orderkey AS name, (upto + 32)::BIGINT AS declared, upto::BIGINT AS expected FROM p WHERE o_orderkey % 13 = 0""")
def offset_audit(spark, sf_dir):
    """Declared offsets that aren't the aligned end of what stands before; one in thirteen is made wrong."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("name"), F.rint(F.col("o_totalprice") / 100).cast("long").alias("n"))
    upto = F.coalesce(F.sum(F.floor((F.col("n") + 31) / 32) * 32).over(Window.partitionBy("file").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    declared = s.withColumn("declared", upto + F.when(F.col("name") % 13 == 0, 32).otherwise(0))
    return layout.broken_offsets(declared, "file", "name", "declared", "n").select("file", "name", "declared", "expected")


@query("""WITH d AS (SELECT d.*, l.quality, l.toxic, row_number() OVER (PARTITION BY text ORDER BY d.doc_id) AS again FROM documents d LEFT JOIN labels l USING (doc_id)),
  v AS (SELECT *, CASE WHEN quality = 1 THEN 'clean' WHEN toxic = 1 THEN 'broken' ELSE 'context' END AS verdict FROM d)
SELECT count(*) AS files, count(*) FILTER (verdict = 'clean') AS clean, count(*) FILTER (verdict = 'context') AS context, count(*) FILTER (verdict = 'broken') AS broken, count(*) FILTER (verdict <> 'broken' AND length(text) < 200) AS too_small,
  count(*) FILTER (verdict <> 'broken' AND length(text) > 60000) AS too_big, count(*) FILTER (verdict <> 'broken' AND length(text) BETWEEN 200 AND 60000 AND again > 1) AS dupes,
  count(*) FILTER (verdict <> 'broken' AND length(text) BETWEEN 200 AND 60000 AND again = 1) AS kept, sum(length(text)) FILTER (verdict <> 'broken' AND length(text) BETWEEN 200 AND 60000 AND again = 1)::BIGINT AS chars FROM v""")
def build_counters(spark, sf_dir):
    """The nine counters of a corpus build in one pass; first copies are met by minima, not by sorting."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"), F.length("text").alias("n"))
    first = d.groupBy("k").agg(F.min("doc_id").alias("first"))
    v = d.join(first, "k").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("verdict", F.when(F.col("quality") == 1, "clean").when(F.col("toxic") == 1, "broken").otherwise("context"))
    good, fits_ = F.col("verdict") != "broken", F.col("n").between(200, 60000)
    new = good & fits_ & (F.col("doc_id") == F.col("first"))
    is_ = lambda name: F.count_if(F.col("verdict") == name).alias(name)
    return v.agg(F.count("*").alias("files"), is_("clean"), is_("context"), is_("broken"), F.count_if(good & (F.col("n") < 200)).alias("too_small"), F.count_if(good & (F.col("n") > 60000)).alias("too_big"), F.count_if(good & fits_ & (F.col("doc_id") != F.col("first"))).alias("dupes"), F.count_if(new).alias("kept"), F.sum(F.when(new, F.col("n"))).alias("chars"))


@query("""WITH p AS (SELECT lang AS version, source, count(*) AS files, sum(length(text)) AS chars FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY chars DESC) - 1 AS i, count(*) OVER (PARTITION BY version) AS n FROM p)
SELECT version, count(*) AS projects, sum(files)::BIGINT AS files, sum(chars)::BIGINT AS chars, max(chars)::BIGINT AS most, (max(chars) FILTER (i = n // 2))::BIGINT AS middle, min(chars)::BIGINT AS least FROM r GROUP BY 1""")
def version_stats(spark, sf_dir):
    """Projects, files and characters by version (language), and the largest, middle and smallest project."""
    p = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("version"), "source").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))
    sums = p.groupBy("version").agg(F.count("*").alias("projects"), F.sum("files").alias("files"), F.sum("chars").alias("chars"), F.max("chars").alias("most"), F.min("chars").alias("least"), F.sort_array(F.collect_list("chars"), False).alias("all"))
    return sums.select("version", "projects", "files", "chars", "most", F.col("all")[F.floor(F.col("projects") / 2).cast("int")].alias("middle"), "least")


@query("""WITH t AS (SELECT lang AS version, length(text) AS chars, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\\s]')) AS n FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY version) AS t FROM t)
SELECT version, count(*) AS files, sum(chars)::BIGINT AS chars, sum(n)::BIGINT AS tokens, max(n) FILTER (i = least(t - 1, floor(t * 0.5))) AS p50, max(n) FILTER (i = least(t - 1, floor(t * 0.9))) AS p90, max(n) FILTER (i = least(t - 1, floor(t * 0.99))) AS p99, max(n) AS most, count(*) FILTER (n >= 256) AS long, round(sum(n) / greatest(sum(chars), 1)::DOUBLE, 6) + 0.0 AS share FROM s GROUP BY 1""")
def token_stats(spark, sf_dir):
    """Tokens (words, digits, marks) by version: sums, ranks, the longest, how many have 256 or more, and tokens a character."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("version"), F.length("text").alias("chars"), F.regexp_count("text", F.lit(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\s]")).cast("long").alias("tokens"))
    ranks = stats.nearest_rank(d, ["version"], "tokens", [0.5, 0.9, 0.99]).drop("n")
    sums = d.groupBy("version").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"), F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.count_if(F.col("tokens") >= 256).alias("long"))
    return sums.join(ranks, "version").select("version", "files", "chars", F.col("t").alias("tokens"), "p50", "p90", "p99", "most", "long", r6(F.col("t") / F.greatest("chars", F.lit(1)), "share"))


@query("""WITH n AS (SELECT doc_id, ['MIT', 'GPL-3.0', 'Apache-2.0', 'x-mit-like', 'ISC', 'proprietary', 'CC0-1.0', 'BSD-3-Clause', 'AGPL', 'zlib'][1 + doc_id % 10] AS l, octet_length(encode(text)) AS size FROM documents)
SELECT doc_id FROM n WHERE size BETWEEN 300 AND 8000 AND doc_id % 10 IN (0, 2, 3, 4, 6, 7, 9)""")
def licensed_files(spark, sf_dir):
    """Files whose licences hold one of the names; 'x-mit-like' does, 'AGPL' does not."""
    names = F.array(*[F.lit(x) for x in ("MIT", "GPL-3.0", "Apache-2.0", "x-mit-like", "ISC", "proprietary", "CC0-1.0", "BSD-3-Clause", "AGPL", "zlib")])
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.octet_length("text").alias("size"), F.array(F.lit("other"), F.get(names, (F.col("doc_id") % 10).cast("int"))).alias("licenses"))
    return corpus.quality_filter(d).select("doc_id")


@query(f"WITH {C}, g AS (SELECT col, round(sum(w * w), 6) + 0.0 AS diag FROM c GROUP BY 1), p AS (SELECT col, row_number() OVER (ORDER BY diag DESC, col) - 1 AS place FROM g) SELECT place AS i, col AS perm, (SELECT q.place FROM p q WHERE q.col = p.place) AS inverse FROM p")
def order_and_inverse(spark, sf_dir):
    """The order of columns by falling diagonal, and the permutation that undoes it; a row a column."""
    d = layout.cells(_w(spark, sf_dir)).groupBy("col").agg((F.round(F.sum(F.col("w") * F.col("w")), 6) + 0.0).alias("diag"))
    p = d.withColumn("place", (F.row_number().over(Window.orderBy(F.desc("diag"), "col")) - 1).cast("long"))
    back = p.select(F.col("col").cast("long").alias("i"), F.col("place").alias("inverse"))
    return p.select(F.col("place").alias("i"), F.col("col").alias("perm")).join(back, "i")


_U = "((('0x' || substr(md5('5::' || tensor || ':' || row || ':' || col || ':dither'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query(f"WITH {M}, j AS (SELECT c.tensor AS tensor, c.row AS row, c.col AS col, w / m * 7 + 7 AS x FROM c JOIN m USING (tensor, row)) SELECT tensor, row, col, least(greatest(floor(x) + ({_U} < x - floor(x))::INT, 0), 14)::INT AS d FROM j")
def dithered_digits(spark, sf_dir):
    """Digits rounded up as often as their fraction says, by hashes."""
    w = _w(spark, sf_dir).withColumn("m", layout.absmax("v"))
    up = lambda i: channel.uniform(F.concat_ws(":", F.lit("5"), F.lit(""), F.col("tensor").cast("string"), F.col("row").cast("string"), i.cast("string"), F.lit("dither")))
    d = F.transform("v", lambda x, i: grid.let(x / F.col("m") * 7 + 7, lambda y: F.least(F.greatest(F.floor(y) + (up(i) < y - F.floor(y)).cast("int"), F.lit(0)), F.lit(14)).cast("int")))
    return w.select("tensor", "row", F.posexplode(d).alias("col", "d"))


@query(f"WITH {C} SELECT tensor, row, col, (w > -0.2)::INT + (w > -0.1)::INT + (w > 0.0)::INT + (w > 0.1)::INT + (w > 0.2)::INT AS cell FROM c")
def boundary_cells(spark, sf_dir):
    """The cell of each weight between given boundaries; a weight on a boundary is in the cell below it."""
    return layout.cells(_w(spark, sf_dir)).select("tensor", "row", "col", grid.cell(F.col("w"), [-0.2, -0.1, 0.0, 0.1, 0.2]).alias("cell"))


_STOPS = ((0.0, 0, 0, 4), (0.25, 87, 16, 110), (0.5, 188, 55, 84), (0.75, 249, 142, 9), (1.0, 252, 255, 164))


def _ramp(e: str, channel_: int) -> str:
    steps = " ".join(f"WHEN {e} <= {b[0]} THEN {a[channel_]} + {b[channel_] - a[channel_]}.0::DOUBLE * ({e} - {a[0]}) / {b[0] - a[0]}" for a, b in zip(_STOPS, _STOPS[1:]))
    return f"CASE {steps} ELSE {_STOPS[-1][channel_]} END"


@query(f"WITH {M}, e AS (SELECT c.tensor, c.row, c.col, round_even(least(abs(w - m * (least(greatest(round_even((w + m) * (4.0::DOUBLE / greatest(m, 1e-30)), 0), 0), 8) - 4) / 4.0::DOUBLE) * 64, 1.0) * 255, 0) / 255 AS e FROM c JOIN m USING (tensor, row)) SELECT tensor, row, col, {', '.join(f'floor({_ramp("e", k)} + 1e-9)::INT AS {n}' for k, n in ((1, 'red'), (2, 'green'), (3, 'blue')))} FROM e")
def error_colours(spark, sf_dir):
    """Errors enlarged 64 times as colours on the broken line through five stops."""
    d = layout.digit_cells(_w(spark, sf_dir), 9)
    e = F.rint(F.least(F.abs(F.col("w") - grid.dequantize(F.col("d"), F.col("m"), 9)) * 64, F.lit(1.0)) * 255) / 255
    line = lambda k: F.array(*[F.struct(F.lit(s[0]).alias("x"), F.lit(float(s[k])).alias("y")) for s in _STOPS])
    shade = lambda k, n: F.floor(cost.interpolated(F.col("e"), line(k)) + 1e-9).cast("int").alias(n)
    return d.withColumn("e", e).select("tensor", "row", "col", shade(1, "red"), shade(2, "green"), shade(3, "blue"))
