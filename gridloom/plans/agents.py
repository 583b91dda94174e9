"""Queries over replies, edits, checks and verdicts made from the tables' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import agents, corpus
from gridloom.plans.registry import query, table


def _s(x: str):
    return F.lit(x)


def _id():
    return F.col("event_id").cast("string")


@query("""SELECT event_id AS id,
  CASE WHEN event_id % 7 IN (0, 5) THEN 'ok' WHEN event_id % 7 IN (1, 3) THEN 'parse_error' WHEN event_id % 7 = 2 THEN 'runtime_error' ELSE 'error' END AS status,
  CASE event_id % 7 WHEN 1 THEN 'parse_error:bad ' || event_type || ':' || event_id || ':reload:a.gd' WHEN 2 THEN 'runtime_error:slow ' || event_type || ':3:_ready:b.gd'
    WHEN 3 THEN 'runtime_error:x:3:f:c.gd|parse_error:Parse ' || event_type || ':0::d.gd' WHEN 4 THEN 'error:no ' || event_type || ':0::' ELSE '' END AS errors
FROM events""")
def engine_verdicts(spark, sf_dir):
    """What an engine prints: nothing, a script that does not parse, one that fails, scripts that do not load, plain errors, noise."""
    said = (
        F.when(F.col("event_id") % 7 == 1, F.concat(_s("x\nSCRIPT ERROR: Parse Error: bad   "), "event_type", _s("\n          at: reload (res://d/a.gd:"), _id(), _s(")\nERROR: more\n")))
        .when(F.col("event_id") % 7 == 2, F.concat(_s("SCRIPT ERROR: slow "), "event_type", _s("\n   at: _ready (res://b.gd:3)\n")))
        .when(F.col("event_id") % 7 == 3, F.concat(_s('SCRIPT ERROR: x\n at: f (res://c.gd:3)\nFailed to load script "res://c.gd" with error "late"\nFailed to load script "res://d.gd" with error "Parse '), "event_type", _s('"\nFailed to load script "res://d.gd" with error "again"\n')))
        .when(F.col("event_id") % 7 == 4, F.concat(_s("ERROR: no "), "event_type", _s("\nERROR: VULKAN is off\n")))
        .when(F.col("event_id") % 7 == 5, "ERROR: no OpenGL here\n").otherwise("fine\n")
    )
    code = F.when(F.col("event_id") % 7 == 6, 1).otherwise(0)
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), agents.engine_verdict(said, code).alias("v"))
    parts = F.transform("v.errors", lambda e: F.concat_ws(":", e["kind"], e["message"], e["line"].cast("string"), e["func"], e["file"]))
    return v.select("id", "v.status", F.array_join(parts, "|").alias("errors"))


_WORDS = "w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM documents)"


@query(f"""WITH {_WORDS}, f AS (SELECT doc_id, w, list_filter([w[2], w[3], w[2]] || CASE WHEN doc_id % 2 = 0 THEN ['main'] ELSE [] END, lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'return', 'catch')) AS fs FROM w WHERE len(w) >= 3),
  u AS (SELECT *, list_filter(fs, lambda x, i: list_position(fs, x) = i) AS us FROM f)
SELECT doc_id, 'Write the complete C++17 source file for `' || doc_id || '.cpp` — a self-contained file that compiles with `g++ -std=c++17 -fsyntax-only` alone.' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'It is a complete runnable program (it has main()).' || chr(10) ELSE '' END || 'Types to define: ' || w[1] || chr(10)
  || CASE WHEN len(us) > 0 THEN 'Functions it defines: ' || array_to_string(us, ', ') || chr(10) ELSE '' END
  || 'Your reply must include the file''s #include lines. No TODOs, no placeholders, no example usage.' AS prompt FROM u""")
def source_prompts(spark, sf_dir):
    """Prompts for source files made of each document's first words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", _s("[A-Za-z]{3,}"), F.lit(0)).alias("w")).where("size(w) >= 3")
    w = [F.col("w")[k] for k in range(3)]
    code = F.concat(
        _s("#include <vector>\nstruct "), w[0], _s(" { int a; };\nint "), w[1], _s("(int a) {\n    if (a) { return g(1); }\n}\nstatic std::vector<int> "), w[2], _s("(const int &b, int (*f)(int)) const noexcept {\n}\nvoid "), w[1], _s("() {\n}\n"),
        F.when(F.col("doc_id") % 2 == 0, "int main() {\n}\n").otherwise(""),
    )
    return d.select("doc_id", agents.source_prompt(code, F.concat(F.col("doc_id").cast("string"), _s(".cpp"))).alias("prompt"))


@query("""WITH c AS (SELECT *, conv_id % 3 = 0 AS run, CASE WHEN turn % 3 = 0 THEN 'ok' WHEN turn % 3 = 1 THEN 'runtime_error' ELSE 'parse_error' END AS status FROM conversations),
  j AS (SELECT conv_id, turn, status = 'ok' OR (run AND status = 'runtime_error') AS parses, CASE WHEN run THEN status <> 'runtime_error' ELSE status = 'ok' END AS builds,
    CASE WHEN run THEN contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'e t') END AS output, contains(lower(text), 'e') AS api, NOT contains(lower(text), 'zz') AND NOT regexp_matches(text, '\\d{6}') AS no_bad FROM c)
SELECT *, parses AND builds AND coalesce(output, true) AND api AND no_bad AS correct FROM j""")
def judged_replies(spark, sf_dir):
    """Turns judged as programs: some were run, and their text stands for what they printed."""
    c = table(spark, sf_dir, "conversations")
    status = F.when(F.col("turn") % 3 == 0, "ok").when(F.col("turn") % 3 == 1, "runtime_error").otherwise("parse_error")
    v = agents.judged(F.col("text"), F.col("conv_id") % 3 == 0, status, F.col("text"), _s("E T"), F.array(_s("E")), F.array(_s("ZZ")), F.col("text").rlike(r"\d{6}"))
    return c.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.*")


@query("""SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 17 END::INT AS n, CASE conv_id % 6 WHEN 0 THEN text || chr(10) || 'x' WHEN 1 THEN NULL END AS first_text,
  CASE conv_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'too many edits' WHEN 2 THEN 'no block of edits' WHEN 3 THEN 'not valid JSON' WHEN 4 THEN 'not an array' ELSE 'no block of edits' END AS error FROM (
  SELECT conv_id, turn, regexp_replace(text, '["\\\\\\x00-\\x1F]', ' ', 'g') AS text FROM conversations)""".replace("WHEN 1 THEN 17 END::INT AS n", "END::INT AS n"))
def edit_blocks(spark, sf_dir):
    """Replies with two edits (a raw line end in a text), too many, none, broken ones, and an object in place of an array."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r'["\\\x00-\x1F]', " ").alias("t"))
    two = F.concat(_s('so\n```edits\n[{"op": "set", "section": "a", "text": "'), "t", _s('\nx"}, {"op": "delete", "section": "b", "find": "q"}]\n```\nend'))
    many = F.concat(_s("```json\n["), F.array_join(F.array_repeat(_s('{"op":"set"}'), 17), ","), _s("]\n```"))
    case = F.col("conv_id") % 6
    reply = F.when(case == 0, two).when(case == 1, many).when(case == 2, "nothing").when(case == 3, '```edits\n[{"op": \n```').when(case == 4, '```edits\n{"op": "set"}\n```').otherwise("```py\nx\n```")
    e = c.select("conv_id", "turn", agents.edit_block(reply).alias("e"))
    return e.select("conv_id", "turn", F.when(F.col("e.ops").isNotNull(), F.size("e.ops")).alias("n"), F.get_json_object(F.col("e.ops")[0], "$.text").alias("first_text"), "e.error")


@query("""WITH b AS (SELECT conv_id, turn, role, trim(text) AS t FROM conversations WHERE trim(text) <> ''), a AS (SELECT *, t || chr(10) || chr(10) || role || '.' AS a FROM b)
SELECT conv_id, turn, CASE WHEN contains(a, 'the') THEN substr(a, 1, strpos(a, 'the') - 1) || 'THE' || substr(a, strpos(a, 'the') + 3) ELSE a END AS a, '' AS b, 'kept' AS c,
  CASE WHEN contains(a, 'the') THEN '' ELSE '2: not found|' END || '4: no such section|5: unknown op|6: no section|7: no text' AS errors FROM a""")
def edited_sections(spark, sf_dir):
    """A fold of eight edits over each turn's sections, five or six of which can be made."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.trim("text").alias("t")).where("t <> ''")
    none = F.lit(None).cast("string")
    edit = lambda op, section, text=none, find=none: F.struct(_s(op).alias("op"), F.lit(section).cast("string").alias("section"), text.alias("text"), find.alias("find"))
    ops = F.array(
        edit("set", "a", F.col("t")), edit("append", "a", F.concat("role", _s("."))), edit("replace", "a", _s("THE"), _s("the")), edit("delete_section", "b"),
        edit("delete", "zz", none, _s("x")), edit("rename", "a"), edit("set", ""), edit("file_code", "c"),
    )
    e = c.select("conv_id", "turn", agents.edited(F.create_map(_s("b"), _s("old"), _s("c"), _s("kept")), ops).alias("e"))
    return e.select("conv_id", "turn", *[F.col("e.sections")[k].alias(k) for k in "abc"], F.array_join("e.errors", "|").alias("errors"))


@query("""WITH s AS (SELECT conv_id, turn, role, text, 'tool-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS entry, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM conversations)
SELECT conv_id, turn, entry, upto <= 500 AS kept, CASE WHEN upto <= 500 THEN regexp_replace(substr(text, 1, 40), '\\s+$', '') || chr(10) || '[filed as ' || entry || ', ' || length(text) || ' characters]' ELSE '[pruned ' || length(text) || ' characters: ' || entry || ' ' || role || ']' END AS stub FROM s""")
def filed_outputs(spark, sf_dir):
    """Long outputs filed under numbers, with stubs for the newest and notes for the oldest."""
    c = table(spark, sf_dir, "conversations")
    return agents.filed(c, "conv_id", ["turn", "role"], "role", "text", 500, 40).select("conv_id", "turn", "entry", "kept", "stub")


@query("""SELECT doc_id, 'starts_upper' || CASE WHEN regexp_matches(text, '^[A-Z]') THEN ':p' ELSE ':f' END || ' has_lines' || CASE WHEN contains(text, chr(10)) THEN ':p' ELSE ':f' END || ' line_starts_the' || CASE WHEN regexp_matches(text, '(?m)^the\\b') THEN ':p' ELSE ':f' END
  || ' no_digit' || CASE WHEN NOT regexp_matches(text, '[0-9]') THEN ':p' ELSE ':f' END || ' long' || CASE WHEN length(text) >= 500 THEN ':p' ELSE ':f' END || ' stop' || CASE WHEN suffix(rtrim(text), '.') THEN ':p' ELSE ':f' END AS checks FROM documents""")
def named_checks(spark, sf_dir):
    """Six named checks over each text."""
    t = F.col("text")
    checks = {"starts_upper": t.rlike("^[A-Z]"), "has_lines": F.contains(t, _s("\n")), "line_starts_the": t.rlike(r"(?m)^the\b"), "no_digit": ~t.rlike("[0-9]"), "long": F.length(t) >= 500, "stop": F.endswith(F.rtrim(t), _s("."))}
    return table(spark, sf_dir, "documents").select("doc_id", agents.check_list(checks).alias("checks"))


@query("""SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN CASE WHEN contains(lower(w), 'a') THEN 'ok' ELSE 'recall_player_missing' END WHEN 1 THEN 'recall_block_fail' WHEN 2 THEN CASE WHEN contains(lower(w), 'a') THEN 'ok_bare_sections' ELSE 'recall_fail' END ELSE 'recall_fail' END AS status
FROM (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]+') AS w FROM conversations) WHERE w <> ''""")
def recall_scores(spark, sf_dir):
    """Replies of three blocks, of three with a broken one, of headed sections, of one section, and of none; 'BROKEN' does not parse."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract("text", "[A-Za-z]+", 0).alias("w")).where("w <> ''")
    block = lambda x: F.concat(_s("```gd\n"), x, _s("\n```\n"))
    case = F.col("conv_id") % 5
    reply = (
        F.when(case == 0, F.concat(block(F.col("w")), block(_s("x")), block(_s("y")))).when(case == 1, F.concat(block(F.col("w")), block(_s("BROKEN")), block(_s("y"))))
        .when(case == 2, F.concat(_s("## one\n"), "w", _s("\n## two\nxx\n## three\nBROKEN\n"))).when(case == 3, F.concat(_s("## one\n"), "w")).otherwise("no")
    )
    return c.select("conv_id", "turn", agents.recalled(reply, lambda x: ~F.contains(x, _s("BROKEN")), "a").alias("status"))


@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 2 = 1 THEN 'a={"type":"string","required":true} b={"required":true} c={"type":"number"}' ELSE 'a={"type":"string"} b={} c={"type":"number"}' END AS properties FROM part""")
def tool_schemas(spark, sf_dir):
    """Schemas with two required properties, with none, and some that are no objects."""
    p = table(spark, sf_dir, "part")
    props = F.create_map(_s("a"), _s('{"type":"string"}'), _s("b"), _s("{}"), _s("c"), _s('{"type":"number"}'))
    kind = F.when(F.col("p_size") % 4 == 0, "string").otherwise("object")
    s = p.select("p_partkey", agents.tool_schema(F.col("p_name"), F.col("p_type"), kind, props, F.when(F.col("p_size") % 2 == 1, F.array(_s("a"), _s("b")))).alias("s"))
    return s.select("p_partkey", "s.name", F.array_join(F.transform(F.map_entries("s.properties"), lambda x: F.concat(x["key"], _s("="), x["value"])), " ").alias("properties"))


@query("SELECT conv_id, sum(octet_length(encode(text))) FILTER (role = 'assistant')::BIGINT AS resident, count(*) FILTER (role = 'assistant') AS outputs, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY 1")
def resident_bytes(spark, sf_dir):
    """Bytes of outputs that a conversation still holds, beside all its bytes."""
    n, own = F.octet_length("text"), F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(own, n)).alias("resident"), F.count_if(own).alias("outputs"), F.sum(n).alias("bytes"))


@query("SELECT item_id, text FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def task_subset(spark, sf_dir):
    """The tasks whose id is in a set of ids."""
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id"))
    return table(spark, sf_dir, "benchmark").join(wanted, "item_id", "left_semi").select("item_id", "text")


@query("SELECT conv_id, count(*) AS files, sum(length(text))::BIGINT AS chars FROM conversations WHERE role = 'user' GROUP BY 1")
def language_files(spark, sf_dir):
    """Of each conversation's map of files (turn -> role, text), those of one language (role)."""
    entry = F.struct("turn", F.struct("role", "text").alias("f"))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("files"))
    own = files.select("conv_id", F.map_values(F.map_filter("files", lambda k, v: v["role"] == "user")).alias("own")).where("size(own) > 0")
    return own.select("conv_id", F.size("own").cast("long").alias("files"), F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("chars"))


@query("""WITH b AS (SELECT d.source, count(*) AS n, count(*) FILTER (l.quality = 1) AS before, count(*) FILTER (l.quality = 1 OR l.toxic = 0) AS after FROM documents d JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, n, round(100.0::DOUBLE * before / n, 1) + 0.0 AS before, round(100.0::DOUBLE * after / n, 1) + 0.0 AS after, after - before AS gained, n - after AS ceiling FROM b""")
def coverage_gap(spark, sf_dir):
    """Rows right before and after context is given, and what no context mends: the difference of the sets."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    first, then = F.col("quality") == 1, (F.col("quality") == 1) | (F.col("toxic") == 0)
    g = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(first).alias("b"), F.count_if(then).alias("a"))
    share = lambda c, name: (F.round(100.0 * F.col(c) / F.col("n"), 1) + 0.0).alias(name)
    return g.select("source", "n", share("b", "before"), share("a", "after"), (F.col("a") - F.col("b")).alias("gained"), (F.col("n") - F.col("a")).alias("ceiling"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 12")
def first_failures(spark, sf_dir):
    """The first twelve failures, as samples for a report (the limit is the report)."""
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", "quality", "toxic").orderBy("doc_id").limit(12)


@query("""WITH p AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS b, length(text) >= 1000 AS ok FROM documents),
  s AS (SELECT source, b, sum(ok::INT) AS n FROM p GROUP BY 1, 2), t AS (SELECT source, b, coalesce(sum(n) OVER (PARTITION BY source ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT p.doc_id FROM p JOIN t USING (source, b) WHERE before < 5""")
def capped_batches(spark, sf_dir):
    """Documents of each source in batches of eight, until five long ones or more have been seen at the end of a batch."""
    d = table(spark, sf_dir, "documents")
    return agents.capped_by_batch(d, "source", ["doc_id"], 8, 5, F.length("text") >= 1000).select("doc_id")


@query("""WITH w AS (SELECT source, unnest(list_distinct(regexp_extract_all(text, '(?m)^([A-Z]\\w*)', 1))) AS name, 1 AS d FROM documents UNION ALL SELECT source, unnest(list_distinct(regexp_extract_all(text, '\\. ([A-Z]\\w*)', 1))), 2 FROM documents),
  n AS (SELECT source, name FROM w GROUP BY 1, 2 HAVING count(DISTINCT d) = 2)
SELECT source AS project, string_agg(name, ' ' ORDER BY name) AS resolved FROM n GROUP BY 1""")
def resolved_classes(spark, sf_dir):
    """Names used (after a full stop) in a source that a line of the same source begins with."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("text").alias("code"))
    return corpus.resolved_classes(files, r"(?m)^([A-Z]\w*)", r"\. ([A-Z]\w*)").select("project", F.array_join("resolved", " ").alias("resolved"))


@query("""WITH c AS (SELECT *, json_object('k', round(value)::BIGINT, 't', event_type)::VARCHAR AS args FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, args ORDER BY event_id) > 1 AS again FROM c""")
def repeated_signatures(spark, sf_dir):
    """Calls that repeat an earlier one of the user: arguments are compared as objects, whatever the order of their keys."""
    k, t = F.concat(_s('"k": '), F.round("value").cast("long").cast("string")), F.concat(_s('"t": "'), "event_type", _s('"'))
    args = F.concat(_s("{"), F.when(F.col("event_id") % 2 == 0, F.concat(k, _s(", "), t)).otherwise(F.concat(t, _s(","), k)), _s("}"))
    return corpus.repeated_calls(table(spark, sf_dir, "events").withColumns({"name": _s("call"), "args": args}), "user_id", "event_id", "name", "args").select("user_id", "event_id", "again")


@query("""SELECT v AS version, n, row_number() OVER (ORDER BY v = '?', v) AS place FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN '?' ELSE regexp_extract(source, '\\d') END AS v, count(*) AS n FROM documents GROUP BY 1)""")
def version_order(spark, sf_dir):
    """Counts by version, the unknown one last; a row a version."""
    from pyspark.sql import Window

    v = F.when(F.col("doc_id") % 11 == 0, "?").otherwise(F.regexp_extract("source", r"\d", 0))
    g = table(spark, sf_dir, "documents").groupBy(v.alias("version")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("version") == "?", "version")))


@query("""SELECT to_json({'rows': count(*), 'sources': count(DISTINCT source), 'chars': sum(length(text))::BIGINT, 'longest': max(length(text))})::VARCHAR AS stats FROM documents""")
def stats_sidecar(spark, sf_dir):
    """The statistics that go beside a written corpus, as one JSON object."""
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))
    return d.select(F.to_json(F.struct("rows", "sources", "chars", "longest")).alias("stats"))


@query("""SELECT id, prompt, run, expect, list_sort(must)::VARCHAR AS must FROM (VALUES ('sum', 'Add two numbers', true, '3', ['int', '+']), ('list', 'Reverse a list', false, NULL, ['reverse'])) t(id, prompt, run, expect, must)""")
def task_table(spark, sf_dir):
    """Tasks declared as rows."""
    tasks = agents.task_table(spark, [{"id": "sum", "prompt": "Add two numbers", "run": True, "expect": "3", "must": ["int", "+"]}, {"id": "list", "prompt": "Reverse a list", "must": ["reverse"]}])
    return tasks.select("id", "prompt", "run", "expect", F.concat(_s("["), F.array_join(F.sort_array("must"), ", "), _s("]")).alias("must"))
