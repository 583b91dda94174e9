"""Queries over documents, conversations and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.functions import text as T
from gridloom.operators import corpus, stats
from gridloom.plans.registry import query, r6, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.08")
def hash_sample(spark, sf_dir):
    return _docs(spark, sf_dir).where(T.hash_share(F.col("doc_id").cast("string")) < 0.08).select("doc_id")


@query("SELECT doc_id, source, ('0x' || substr(sha1(source), 1, 8))::BIGINT % 5 = 0 AS held FROM documents")
def holdout_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "source", T.held_out(F.col("source"), 5, 0).alias("held"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_equal(spark, sf_dir):
    return corpus.keep_first(_docs(spark, sf_dir).select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query("SELECT source, count(*) FILTER (length(text) < 200) AS small, count(*) FILTER (length(text) > 60000) AS big, count(*) FILTER (length(text) BETWEEN 200 AND 60000) AS kept FROM documents GROUP BY 1")
def size_band(spark, sf_dir):
    n = F.length("text")
    return _docs(spark, sf_dir).groupBy("source").agg(F.count_if(n < 200).alias("small"), F.count_if(n > 60000).alias("big"), F.count_if(n.between(200, 60000)).alias("kept"))


@query("SELECT doc_id FROM documents WHERE length(text) >= 20 AND length(trim(text)) >= 20 AND octet_length(encode(text)) BETWEEN 300 AND 8000")
def byte_band(spark, sf_dir):
    return _docs(spark, sf_dir).where((F.length(F.trim("text")) >= 20) & F.octet_length("text").between(300, 8000)).select("doc_id")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, avg(length(line)) AS a, max(length(line)) AS m FROM l GROUP BY 1), f AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(text)::DOUBLE AS x, octet_length(encode(text)) AS size FROM documents)"


@query(f"WITH {_LINES} SELECT doc_id FROM s JOIN f USING (doc_id) WHERE size BETWEEN 300 AND 8000 AND NOT (a > 200 OR m > 1000 OR NOT x BETWEEN 0.25 AND 0.95)")
def line_quality(spark, sf_dir):
    lens = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    avg = grid.let(lens, lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(n))
    d = _docs(spark, sf_dir).select(
        "doc_id", F.col("text").alias("content"), F.octet_length("text").alias("size"), F.array_max(lens).alias("max_line_length"),
        avg.alias("avg_line_length"), (F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) / F.nullif(F.length("text"), F.lit(0))).alias("alphanum_fraction"),
    )
    return corpus.quality_filter(d).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'MIT|Apache|GNU|BSD|CC')")
def named_license(spark, sf_dir):
    """Documents that name a licence: plain substrings, no pattern machine."""
    return _docs(spark, sf_dir).where(F.exists(F.array(*[F.lit(x) for x in ("MIT", "Apache", "GNU", "BSD", "CC")]), lambda x: F.contains(F.col("text"), x))).select("doc_id")


@query("WITH v AS (SELECT CASE WHEN regexp_extract(substr(source, 4), '^(\\d+)', 1) = '' THEN '?' ELSE regexp_extract(substr(source, 4), '^(\\d+)', 1) END AS v FROM documents) SELECT v AS major, count(*) AS n FROM v GROUP BY 1")
def by_major(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(T.major(F.regexp_replace("source", "^src", "")).alias("major")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT source, lang, count(*) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chars DESC, lang) AS place FROM g) SELECT * FROM r WHERE place <= 5")
def top_languages(spark, sf_dir):
    """The five languages with most characters of each source."""
    g = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("chars"), "lang"))).where("place <= 5")


@query("WITH s AS (SELECT lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS t FROM documents) SELECT lang, t AS n, max(n) FILTER (i = least(t - 1, floor(t * 0.5))) AS p50, max(n) FILTER (i = least(t - 1, floor(t * 0.9))) AS p90, max(n) FILTER (i = least(t - 1, floor(t * 0.99))) AS p99 FROM s GROUP BY 1, 2")
def length_ranks(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", F.length("text").alias("x"))
    return stats.nearest_rank(d, ["lang"], "x", [0.5, 0.9, 0.99])


@query("SELECT source, count(*) AS files, sum(length(text))::BIGINT AS chars, min(length(text)) AS least, max(length(text)) AS most, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 6) + 0.0 AS share FROM documents GROUP BY 1")
def corpus_stats(spark, sf_dir):
    g = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.min(F.length("text")).alias("least"), F.max(F.length("text")).alias("most"))
    total = g.agg(F.sum("files").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("source", "files", "chars", "least", "most", r6(100.0 * F.col("files") / F.col("t"), "share"))


@query("WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT *, (length(line) < 40)::INT AS f, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS n, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id) AS t FROM l) SELECT doc_id, ((n - 1) // 2)::BIGINT AS block, count(*) AS lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM f WHERE f = 0 AND n % 2 = 1 AND n < t GROUP BY 1, 2")
def fenced_blocks(spark, sf_dir):
    """Short lines stand for fences, as the texts hold none."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return corpus.fenced_blocks(lines, "doc_id", "pos", F.length("line") < 40, "line")


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, coalesce(l.toxic, 0)::INT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_lookup(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def without_match(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT k, bool_or(t = 1) AS in_documents, bool_or(t = 2) AS in_labels, bool_or(t = 3) AS in_customer FROM (SELECT doc_id AS k, 1 AS t FROM documents UNION ALL SELECT doc_id, 2 FROM labels UNION ALL SELECT c_custkey, 3 FROM customer) GROUP BY 1")
def three_way_presence(spark, sf_dir):
    """Which of three tables hold each key: full joins, so keys of one table only stay."""
    a = _docs(spark, sf_dir).select(F.col("doc_id").alias("k"), F.lit(True).alias("a"))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.lit(True).alias("b"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(True).alias("c"))
    return a.join(b, "k", "full").join(c, "k", "full").select("k", *[F.coalesce(x, F.lit(False)).alias(n) for x, n in (("a", "in_documents"), ("b", "in_labels"), ("c", "in_customer"))])


@query("WITH m AS (SELECT r.r_name, n.n_name, row_number() OVER (PARTITION BY r.r_name ORDER BY n.n_name) AS place FROM nation n JOIN region r ON contains(lower(n.n_name), lower(substr(r.r_name, -1, 1)))) SELECT * FROM m WHERE place <= 8")
def fuzzy_names(spark, sf_dir):
    """Case-blind substring matches of two tables of fixed size, the first eight of each (the limit is the report)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    m = n.join(F.broadcast(r), F.contains(F.lower("n_name"), F.lower(F.substring("r_name", -1, 1)))).select("r_name", "n_name")
    return m.withColumn("place", F.row_number().over(Window.partitionBy("r_name").orderBy("n_name"))).where("place <= 8")


@query("SELECT DISTINCT p.p_brand, b.x FROM part p, (VALUES ('Brand#1'), ('Brand#2'), ('Brand#33 and more')) b(x) WHERE starts_with(p.p_brand, b.x) OR starts_with(b.x, p.p_brand)")
def prefix_either_way(spark, sf_dir):
    b = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#33 and more",)], "x string")
    return table(spark, sf_dir, "part").select("p_brand").distinct().join(F.broadcast(b), F.startswith("p_brand", "x") | F.startswith("x", "p_brand")).select("p_brand", "x")


@query("(SELECT 'document' AS kind, doc_id AS id, text FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 300) UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def mixture(spark, sf_dir):
    """All of one table and the first 300 of another by hash order (the limit is the mix)."""
    d = _docs(spark, sf_dir).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(300)
    return d.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+')[1:6], ' ') AS firsts FROM documents")
def first_captures(spark, sf_dir):
    got = F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), 1, 6)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(got, " ").alias("firsts"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, substr(md5(source || '/' || doc_id), 1, 12) AS id, regexp_replace(source || ' #' || doc_id, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM documents")
def text_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.squeezed(F.col("text")).alias("squeezed"), T.short_id(F.concat("source", F.lit("/"), F.col("doc_id"))).alias("id"), T.plain_name(F.concat("source", F.lit(" #"), F.col("doc_id"))).alias("name"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'licen[cs]ed?') THEN 'license' WHEN regexp_matches(text, 'password|secret|token') THEN 'secret' WHEN regexp_matches(text, '\\|') THEN 'table' ELSE 'other' END AS bucket FROM documents")
def message_buckets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.bucket_of(F.col("text"), {"license": "licen[cs]ed?", "secret": "password|secret|token", "table": r"\|"}).alias("bucket"))


@query("WITH l AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS ms, bool_or(role = 'system') AS clean FROM conversations WHERE turn > 0 OR role <> 'user' GROUP BY 1) SELECT conv_id, CASE WHEN clean THEN 'clean' WHEN ms IS NULL OR len(ms) = 0 THEN 'broken' WHEN len(list_filter(ms, lambda x: regexp_matches(x, '[a-z]'))) = len(ms) AND len(list_filter(ms, lambda x: regexp_matches(x, 'the|der'))) = 0 THEN 'context' ELSE 'broken' END AS verdict FROM l")
def message_verdicts(spark, sf_dir):
    """A system turn stands for a file that loads; without it, no message is as broken as a wrong one."""
    turns = table(spark, sf_dir, "conversations").where("turn > 0 or role <> 'user'")
    ms = turns.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("ms"), F.bool_or(F.col("role") == "system").alias("clean"))
    return ms.select("conv_id", T.verdict(F.col("ms"), F.col("clean"), "[a-z]", "the|der").alias("verdict"))


@query("SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chars FROM conversations")
def running_chars(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sum(F.length("text")).over(w).alias("chars"))


@query("WITH s AS (SELECT *, sum(CASE WHEN role = 'system' THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS fixed, sum(CASE WHEN role <> 'system' THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS later, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn FROM s WHERE role = 'system' OR back = 1 OR later + fixed <= 800")
def trimmed_context(spark, sf_dir):
    return corpus.trim_context(table(spark, sf_dir, "conversations"), 800).select("conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) > 1 THEN '[stub ' || length(text) || ']' ELSE text END AS text FROM conversations")
def stubbed_outputs(spark, sf_dir):
    """All but the last reply of a conversation become stubs."""
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("role") == "assistant") & (n > 1), F.concat(F.lit("[stub "), F.length("text"), F.lit("]"))).otherwise(F.col("text")).alias("text"))


@query("WITH s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS later FROM conversations) SELECT conv_id, turn FROM s WHERE later <= 600")
def budget_eviction(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").withColumn("later", F.sum(F.length("text")).over(w)).where("later <= 600").select("conv_id", "turn")


@query("WITH s AS (SELECT doc_id, source, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT doc_id, source FROM s WHERE before < 20000")
def packed_rows(spark, sf_dir):
    return corpus.pack(_docs(spark, sf_dir), "source", "doc_id", F.length("text"), 20000).select("doc_id", "source")


@query("SELECT event_id, event_id // 100 AS block FROM events WHERE event_id % 100 < 80")
def spaced_blocks(spark, sf_dir):
    """Blocks of 80 with gaps of 20."""
    return table(spark, sf_dir, "events").where(F.col("event_id") % 100 < 80).select("event_id", F.floor(F.col("event_id") / 100).alias("block"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity * 7)::BIGINT AS n FROM lineitem), o AS (SELECT *, ((n + 31) // 32) * 32 AS padded FROM s) SELECT l_orderkey, l_linenumber, coalesce(sum(padded) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs, n FROM o")
def aligned_offsets(spark, sf_dir):
    """Offsets of blobs laid end to end, each aligned to 32."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 7).cast("long").alias("n"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "n").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("l_orderkey", "l_linenumber", F.coalesce(F.sum(F.floor((F.col("n") + 31) / 32) * 32).over(w), F.lit(0)).alias("offs"), "n")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN 'S' WHEN role = 'user' THEN 'U' ELSE 'A' END || ':' || text, chr(10) ORDER BY turn) AS message FROM conversations GROUP BY 1")
def joined_messages(spark, sf_dir):
    tag = F.when(F.col("role") == "system", "S").when(F.col("role") == "user", "U").otherwise("A")
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(tag, F.lit(":"), "text").alias("t")))).alias("ts"))
    return m.select("conv_id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("message"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type, round(value) ORDER BY event_id) > 1 AS again FROM events")
def repeated_calls(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type", F.round("value")).orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) > 1).alias("again"))


@query("WITH t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (turn > 0) AS body, max(text) FILTER (turn = 0) AS prompt FROM conversations GROUP BY 1), p AS (SELECT conv_id, list_transform(range(1, length(prompt) + 1), lambda i: unicode(prompt[i])) AS prompt, list_transform(range(1, length(body) + 1), lambda i: unicode(body[i])) AS body FROM t WHERE prompt IS NOT NULL AND body IS NOT NULL) SELECT conv_id, 512 AS n, (len(prompt) + least(len(body), 512 - len(prompt)))::INT AS used, coalesce(list_sum(body[1:512 - len(prompt)]), 0)::BIGINT AS loss FROM p WHERE len(prompt) < 504")
def masked_prompts(spark, sf_dir):
    """First turns as prompts of their conversations, code points as tokens: whole texts, a window of 512, padded to it."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("prompt"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "text")))), lambda x: x["text"]), "\n").alias("body"), F.max("turn").alias("last"),
    ).where("prompt is not null and last > 0")
    codes = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int"))
    c = t.select("conv_id", T.masked_labels(codes("prompt"), codes("body"), 512, pad=0).alias("x")).where("x is not null")
    loss = F.aggregate(F.filter("x.labels", lambda y: y != -100), F.lit(0).cast("long"), lambda a, y: a + y)
    return c.select("conv_id", F.size("x.ids").alias("n"), F.col("x.used"), loss.alias("loss"))