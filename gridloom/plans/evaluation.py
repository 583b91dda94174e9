"""Queries that judge draws: votes, pass rates, paired statistics and fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import stats
from gridloom.plans.registry import query, r6, table

_DRAWS = "d AS (SELECT user_id % 50 AS task, event_id AS draw, value > 20 AS a, event_type <> 'click' AS b, event_id % 3 > 0 AS c, value FROM events)"


def _draws(spark, sf_dir):
    """Events as draws of 50 tasks with three checks each."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("task"), F.col("event_id").alias("draw"), (F.col("value") > 20).alias("a"), (F.col("event_type") != "click").alias("b"), (F.col("event_id") % 3 > 0).alias("c"), "value")


@query(f"WITH {_DRAWS}, v AS (SELECT task, 2 * count(*) FILTER (a) > count(*) AS a, 2 * count(*) FILTER (b) > count(*) AS b, 2 * count(*) FILTER (c) > count(*) AS c, count(*) FILTER (a AND b AND c) AS all_three FROM d GROUP BY 1) SELECT task, a, b, c, a AND b AND c AS correct, all_three FROM v")
def majority_vote(spark, sf_dir):
    """Ties count as failed."""
    most = lambda x: (2 * F.count_if(F.col(x)) > F.count("*")).alias(x)
    v = _draws(spark, sf_dir).groupBy("task").agg(most("a"), most("b"), most("c"), F.count_if(F.col("a") & F.col("b") & F.col("c")).alias("all_three"))
    return v.select("task", "a", "b", "c", (F.col("a") & F.col("b") & F.col("c")).alias("correct"), "all_three")


@query(f"WITH {_DRAWS} SELECT task, draw FROM (SELECT task, draw, row_number() OVER (PARTITION BY task ORDER BY (a AND b AND c) DESC, a DESC, b DESC, draw) AS r FROM d) WHERE r = 1")
def representative_draw(spark, sf_dir):
    """The first fully right draw, else the best by its checks: one maximum a task, no sort."""
    key = F.struct((F.col("a") & F.col("b") & F.col("c")).alias("x"), "a", "b", (-F.col("draw")).alias("y"))
    return _draws(spark, sf_dir).groupBy("task").agg(F.max_by("draw", key).alias("draw"))


@query(f"WITH {_DRAWS} SELECT task, draw FROM (SELECT task, draw, row_number() OVER (PARTITION BY task ORDER BY a::INT + b::INT + c::INT DESC, round(value) DESC, draw) AS r FROM d) WHERE r = 1")
def best_candidate(spark, sf_dir):
    hits = F.col("a").cast("int") + F.col("b").cast("int") + F.col("c").cast("int")
    return _draws(spark, sf_dir).groupBy("task").agg(F.max_by("draw", F.struct(hits.alias("h"), F.round("value").alias("v"), (-F.col("draw")).alias("y"))).alias("draw"))


@query(f"WITH {_DRAWS} SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (a) / count(*), 6) + 0.0 AS a, round(100.0::DOUBLE * count(*) FILTER (b) / count(*), 6) + 0.0 AS b, round(100.0::DOUBLE * count(*) FILTER (a AND b AND c) / count(*), 6) + 0.0 AS correct FROM d")
def pass_rates(spark, sf_dir):
    rate = lambda x, n: r6(100.0 * F.count_if(x) / F.count("*"), n)
    return _draws(spark, sf_dir).agg(F.count("*").alias("n"), rate(F.col("a"), "a"), rate(F.col("b"), "b"), rate(F.col("a") & F.col("b") & F.col("c"), "correct"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) + 0.0 AS se FROM events GROUP BY 1")
def mean_and_error(spark, sf_dir):
    return stats.mean_and_error(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", r6(F.col("mean"), "mean"), r6(F.col("se"), "se"))


@query("WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT count(*) AS n, round(avg(a.v - b.v), 6) + 0.0 AS mean, round(stddev_samp(a.v - b.v) / sqrt(count(*)), 6) + 0.0 AS se FROM a JOIN b USING (user_id)")
def paired_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = lambda x: x.groupBy("user_id").agg(F.avg("value").alias("v"))
    p = stats.paired_delta(mean(e.where("event_type = 'click'")), mean(e.where("event_type <> 'click'")), ["user_id"], "v")
    return p.select("n", r6(F.col("mean"), "mean"), r6(F.col("se"), "se"))


@query("SELECT l_returnflag, round(exp(sum(l_tax * l_quantity) / sum(l_quantity)), 6) + 0.0 AS ppl FROM lineitem GROUP BY 1")
def perplexity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("nll", F.col("l_tax") * F.col("l_quantity"))
    return stats.perplexity(rows, ["l_returnflag"], "nll", "l_quantity").select("l_returnflag", r6(F.col("ppl"), "ppl"))


@query("SELECT o_orderpriority AS arm, round(avg((o_orderstatus = 'F')::INT), 6) + 0.0 AS success, round(avg(o_totalprice), 4) + 0.0 AS cost, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def arm_means(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("arm")).agg(r6(F.avg((F.col("o_orderstatus") == "F").cast("int")), "success"), (F.round(F.avg("o_totalprice"), 4) + 0.0).alias("cost"), F.countDistinct("o_custkey").alias("customers"))


@query("WITH h AS (SELECT s_nationkey AS g, 2 * (s_suppkey % 7) + 3 AS k, count(*) AS n FROM supplier GROUP BY 1, 2) SELECT g, sum(n)::BIGINT AS n, arg_max(k, n * 1000 - k)::BIGINT AS modal FROM h GROUP BY 1")
def level_summary(spark, sf_dir):
    h = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("g"), (2 * (F.col("s_suppkey") % 7) + 3).alias("k")).agg(F.count("*").alias("n"))
    return h.groupBy("g").agg(F.sum("n").alias("n"), F.max_by("k", F.struct("n", (-F.col("k")).alias("x"))).alias("modal"))


@query("SELECT p_size AS tap, round(avg(p_retailprice), 6) + 0.0 AS mean, round(stddev_pop(p_retailprice), 6) + 0.0 AS std, count(*) AS n FROM part GROUP BY 1")
def tap_statistics(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("tap")).agg(r6(F.avg("p_retailprice"), "mean"), r6(F.stddev_pop("p_retailprice"), "std"), F.count("*").alias("n"))


@query("WITH f1 AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem), r AS (SELECT l_extendedprice AS y, l_quantity AS x, l_extendedprice - (i + s * l_quantity) AS r FROM lineitem, f1), k AS (SELECT x, y FROM r WHERE abs(r) < 2 * (SELECT greatest(stddev_pop(r), 0.001) FROM r)) SELECT round(regr_slope(y, x), 4) + 0.0 AS slope, round(regr_intercept(y, x), 4) + 0.0 AS intercept, count(*) AS kept FROM k")
def robust_line(spark, sf_dir):
    fit = stats.robust_line(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", 0.001, limit=2.0)
    return fit.select((F.round("slope", 4) + 0.0).alias("slope"), (F.round("intercept", 4) + 0.0).alias("intercept"), "kept")


@query("WITH a AS (SELECT p_size AS tap, var_pop(p_retailprice) AS v FROM part GROUP BY 1), b AS (SELECT p_size AS tap, var_pop(p_partkey) AS v FROM part GROUP BY 1) SELECT tap, round(sqrt(greatest(a.v - b.v, 0)), 6) + 0.0 AS std FROM a JOIN b USING (tap)")
def variance_subtracted(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("tap")).agg(F.var_pop("p_retailprice").alias("a"), F.var_pop("p_partkey").alias("b"))
    return g.select("tap", r6(F.sqrt(F.greatest(F.col("a") - F.col("b"), F.lit(0.0))), "std"))


@query("WITH m AS (SELECT o_orderpriority AS g, o_custkey AS t, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT g, v > lag(v) OVER (PARTITION BY g ORDER BY t) AS up FROM m) SELECT g, bool_and(coalesce(up, true)) AS monotonic, count(*) FILTER (up) AS rises FROM s GROUP BY 1")
def monotonic(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.col("o_custkey").alias("t")).agg(F.avg("o_totalprice").alias("v"))
    up = F.col("v") > F.lag("v").over(Window.partitionBy("g").orderBy("t"))
    return m.withColumn("up", up).groupBy("g").agg(F.bool_and(F.coalesce("up", F.lit(True))).alias("monotonic"), F.count_if(F.col("up")).alias("rises"))


_REPLY = "r AS (SELECT conv_id, turn, text || chr(10) || '```python' || chr(10) || substr(text, 1, 40) || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```' || chr(10) || role || chr(10) || '```' AS reply FROM conversations)"


def _replies(spark, sf_dir):
    """Conversation texts with two fenced blocks after them."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat("text", F.lit("\n```python\n"), F.substring("text", 1, 40), F.lit("\n```\nthen\n```\n"), "role", F.lit("\n```")).alias("reply"))


@query(f"WITH {_REPLY} SELECT conv_id, turn, trim(regexp_extract(reply, '(?s)```[^\\n`]*\\n(.*?)```', 1), ' ' || chr(9) || chr(10) || chr(13)) AS first, trim(regexp_extract_all(reply, '(?s)```[^\\n`]*\\n(.*?)```', 1)[-1], ' ' || chr(9) || chr(10) || chr(13)) AS last FROM r")
def code_blocks(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", T.first_block(F.col("reply")).alias("first"), T.last_block(F.col("reply")).alias("last"))


@query("SELECT doc_id, array_to_string(list_filter(['the', 'licensed', 'password'], lambda x: NOT contains(lower(text), x)), ',') AS missing, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\\bThe\\b') THEN 'the' END, CASE WHEN regexp_matches(text, '!!') THEN 'shout' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END], lambda x: x IS NOT NULL), ',') AS found FROM documents")
def must_and_must_not(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    parts = F.array(*[F.lit(x) for x in ("the", "licensed", "password")])
    return d.select("doc_id", F.array_join(T.missing_parts(F.col("text"), parts), ",").alias("missing"), F.array_join(T.any_match(F.col("text"), {"the": r"\bThe\b", "shout": "!!", "digits": "[0-9]{4}"}), ",").alias("found"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS value FROM events")
def json_fields(spark, sf_dir):
    """The value of each object's first key."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.element_at(F.map_values(F.from_json("props", "map<string,string>")), 1).alias("value"))


@query("SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 6) + 0.0 AS share FROM events GROUP BY 1")
def status_shares(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("event_type", "n", r6(100.0 * F.col("n") / F.col("t"), "share"))
