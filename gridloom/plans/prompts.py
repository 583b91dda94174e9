"""Queries over code made from the documents' words, logs and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import layout, prompts, schemes, stats
from gridloom.plans.quantization import D, M, R6, T as TERNARY, _w
from gridloom.plans.registry import query, r6, table

_CODE = (
    "w AS (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM documents), k AS (SELECT doc_id, source, 'extends ' || w[1] || chr(10) || 'class_name ' || w[2] || chr(10) || '## ' || w[3] || ' ' || w[4] || chr(10) "
    "|| 'signal ' || w[5] || chr(10) || '@export var ' || w[6] || chr(10) || 'func ' || w[7] || '(x):' || chr(10) || '    pass' || chr(10) || 'static func ' || w[8] || '():' || chr(10) AS code, w FROM w WHERE len(w) >= 8)"
)
_PROMPT = "'File: ' || doc_id || '.gd' || chr(10) || 'Base: ' || w[1] || chr(10) || 'Class: ' || w[2] || chr(10) || 'Purpose: ' || w[3] || ' ' || w[4] || chr(10) || 'Signals: ' || w[5] || chr(10) || 'Exports: ' || w[6] || chr(10) || 'Methods: ' || w[7] || '(x); ' || w[8] || '()'"


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project"), F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w")).where("size(w) >= 8")
    w = [F.col("w")[k] for k in range(8)]
    code = F.concat(F.lit("extends "), w[0], F.lit("\nclass_name "), w[1], F.lit("\n## "), w[2], F.lit(" "), w[3], F.lit("\nsignal "), w[4], F.lit("\n@export var "), w[5], F.lit("\nfunc "), w[6], F.lit("(x):\n    pass\nstatic func "), w[7], F.lit("():\n"))
    return d.select("doc_id", "project", F.concat(F.col("doc_id").cast("string"), F.lit(".gd")).alias("path"), code.alias("code"))


@query(f"WITH {_CODE} SELECT source || '::' || doc_id || '.gd' AS id, length(code)::INT AS chars, {_PROMPT} AS prompt, code AS reply FROM k")
def code_samples(spark, sf_dir):
    s = prompts.samples(_files(spark, sf_dir), "Write code only.")
    return s.select("id", "chars", F.col("messages")[1]["content"].alias("prompt"), F.col("messages")[2]["content"].alias("reply"))


@query(f"WITH {_CODE} SELECT source || '::' || doc_id || '.gd' AS id, {_PROMPT} AS prompt FROM k")
def samples_asked_again(spark, sf_dir):
    s = prompts.samples(_files(spark, sf_dir), "x").withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", "old").otherwise(m["content"]).alias("content"))))
    return prompts.asked_again(s).select("id", F.col("messages")[1]["content"].alias("prompt"))


@query("SELECT event_id AS id, 'res://' || event_type || '.gd' AS file, (event_id % 90)::INT AS line, 'Bad ' || event_type AS message FROM events WHERE event_id % 2 = 0")
def log_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    block = F.concat(F.lit("start\nSCRIPT ERROR: Bad "), "event_type", F.lit("\n          at: f (res://"), "event_type", F.lit(".gd:"), (F.col("event_id") % 90).cast("string"), F.lit(")\nend\n"))
    return prompts.error_blocks(e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, block).otherwise("fine\n").alias("log")))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'context' ELSE 'error' END AS status, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type || '.h' ELSE 'no ' || event_type || '|two' END AS errors FROM events")
def compiler_verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("a.cpp:1:10: fatal error: "), "event_type", F.lit(".h: No such file or directory\n"))).when(F.col("event_id") % 3 == 2, F.concat(F.lit("a.cpp:2:1: error: no "), "event_type", F.lit("\na.cpp:3:1: error: two\n"))).otherwise("")
    v = e.select(F.col("event_id").alias("id"), prompts.compiler_verdict(said, F.least(F.col("event_id") % 3, F.lit(1))).alias("v"))
    return v.select("id", "v.status", F.array_join("v.errors", "|").alias("errors"))


@query("SELECT event_id AS id, event_type AS name, '{\"n\":' || (event_id % 7) || '}' AS arguments FROM events WHERE event_id % 4 < 2")
def tool_calls(spark, sf_dir):
    """Calls in tags, or in a JSON fence; other replies hold none."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": {"n": '), (F.col("event_id") % 7).cast("string"), F.lit("}}"))
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("I call\n<tool_call>\n"), body, F.lit("\n</tool_call>"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```"))).otherwise("nothing")
    calls = e.select(F.col("event_id").alias("id"), T.tool_call(reply).alias("c")).where("c is not null")
    return calls.select("id", "c.name", "c.arguments")


@query("SELECT conv_id, turn, len(list_filter(list_distinct([trim('a' || conv_id || chr(10) || 'b' || chr(10) || 'c'), 'a' || conv_id || chr(10) || 'b', 'a' || conv_id, 'b' || chr(10) || 'c', 'c']), lambda x: x <> ''))::INT AS n FROM conversations")
def code_candidates(spark, sf_dir):
    """A block of three lines gives itself, two beginnings and two ends."""
    c = table(spark, sf_dir, "conversations")
    reply = F.concat(F.lit("x\n```py\na"), F.col("conv_id").cast("string"), F.lit("\nb\nc\n```\n"))
    return c.select("conv_id", "turn", F.size(T.candidates(reply, 3)).alias("n"))


@query("SELECT doc_id FROM documents WHERE NOT starts_with(source, 'src1') AND coalesce(lang, 'en') = 'en' AND regexp_matches(source, '[02468]$')")
def path_filters(spark, sf_dir):
    """Left out by prefix, kept by a value whose absence counts as that value, and by a pattern of names."""
    return table(spark, sf_dir, "documents").where(~F.startswith("source", F.lit("src1")) & (F.coalesce("lang", F.lit("en")) == "en") & F.col("source").rlike("[02468]$")).select("doc_id")


@query(f"WITH {D(9)}, o AS (SELECT tensor, d, row_number() OVER (PARTITION BY tensor ORDER BY md5(row || ':' || col), row, col) AS i FROM d), s AS (SELECT tensor, d, lag(d) OVER (PARTITION BY tensor ORDER BY i) AS p FROM o) SELECT tensor, {R6.format('avg(CASE WHEN p = d THEN 1.0 ELSE 0.0 END)')} AS rate FROM s WHERE p IS NOT NULL GROUP BY 1")
def shuffled_match(spark, sf_dir):
    """Match rates of neighbours after a shuffle by hash: the control of the lag rates."""
    d = layout.digit_cells(_w(spark, sf_dir), 9)
    return stats.shuffled_match(d, F.md5(F.concat_ws(":", "row", "col").cast("binary"))).select("tensor", r6(F.col("rate"), "rate"))


_SCHEME_SQL = " UNION ALL ".join(
    [f"SELECT 'k{k}' AS scheme, avg(pow(w - m * (least(greatest(round_even((w + m) * ({(k - 1) // 2}.0::DOUBLE / greatest(m, 1e-30)), 0), 0), {k - 1}) - {(k - 1) // 2}) / {(k - 1) // 2}.0::DOUBLE, 2)) AS e FROM cm" for k in (9, 15)]
    + [f"SELECT 'int{b}', avg(pow(w - least(greatest(round_even(w / (m / {t}), 0), -{t}), {t}) * m / {t}.0::DOUBLE, 2)) FROM cm" for b, t in ((8, 127), (4, 7))]
    + ["SELECT 'ternary', avg(pow(w - t * gamma, 2)) FROM c JOIN t USING (tensor, row, col) JOIN g USING (tensor, row)"]
)


@query(f"WITH {TERNARY}, m AS (SELECT tensor, row, max(abs(w)) AS m FROM c GROUP BY 1, 2), cm AS (SELECT * FROM c JOIN m USING (tensor, row)) SELECT scheme, {R6.format('e * 1e6')} AS error FROM ({_SCHEME_SQL})")
def scheme_errors(spark, sf_dir):
    """Mean square error (times a million) of each named scheme."""
    w, out = _w(spark, sf_dir), None
    own = layout.grouped(w).select("tensor", "row", "grp", "g")
    for name in ("k9", "k15", "int8", "int4", "ternary"):
        q = schemes.quantize(w, name).select("tensor", "row", "grp", "q").join(own, ["tensor", "row", "grp"])
        e = q.select(F.explode(F.arrays_zip("g", "q")).alias("x")).agg(F.avg(F.pow(F.col("x.g") - F.col("x.q"), F.lit(2.0))).alias("e"))
        one = e.select(F.lit(name).alias("scheme"), r6(F.col("e") * 1e6, "error"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {M}, q AS (SELECT tensor, row, col, w, m, abs(w - m * ({'least(greatest(round_even((w + m) * (4.0::DOUBLE / greatest(m, 1e-30)), 0), 0), 8)'} - 4) / 4.0::DOUBLE) * 64 AS e FROM c JOIN m USING (tensor, row)) SELECT tensor, row, col, least(4, floor(least(e, 1.0) * 4))::INT AS stop, {R6.format('least(e, 1.0)')} AS heat FROM q")
def error_heat(spark, sf_dir):
    """Errors enlarged 64 times, cut at 1, and the stop of a five-colour scale that each falls in."""
    from gridloom.functions import grid

    d = layout.digit_cells(_w(spark, sf_dir), 9)
    e = F.least(F.abs(F.col("w") - grid.dequantize(F.col("d"), F.col("m"), 9)) * 64, F.lit(1.0))
    return d.select("tensor", "row", "col", F.least(F.lit(4), F.floor(e * 4).cast("int")).alias("stop"), r6(e, "heat"))


