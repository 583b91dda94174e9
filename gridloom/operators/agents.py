"""Judging and editing what models and tools say: verdicts, prompts, edits, checks and schemas, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import text as T

# What an engine says, and what it says without need.
_SCRIPT = r"SCRIPT ERROR: (?:(Parse Error): )?([^\n]+)\n\s*at: ([^(]*?)\(([^\n]+?):(\d+)\)"
_LOAD = r'Failed to load script "([^"]+)" with error "([^"]+)"'
_ENGINE = r"(?md)^ERROR: (.+)$"
NOISE = (
    "Vulkan", "OpenGL", "display driver", "No loader found for resource", "TextServer", "fontconfig", "X11", "WAYLAND_DISPLAY", "ALSA", "PulseAudio",
    "Unable to load", "Mono", "dotnet", "GLES", "shader", "WARNING:",
)


def engine_verdict(output: Column, returncode: Column) -> Column:
    """(status, errors) of an engine's output: parse_error, runtime_error, error or ok.

    A script that failed to load counts once, and not if an error names its file; other
    errors count only where there are none of these, without noise.
    """
    get = lambda x, pattern, k: F.regexp_extract(x, pattern, k)
    base = lambda path: F.substring_index(path, "/", -1)

    def error(kind: Column, message: Column, line: Column, where: Column, file: Column) -> Column:
        return F.struct(kind.alias("kind"), T.squeezed(message).alias("message"), line.cast("int").alias("line"), F.trim(where).alias("func"), file.alias("file"))

    none, zero = F.lit(""), F.lit(0)
    scripts = F.transform(
        F.regexp_extract_all(output, F.lit(_SCRIPT), F.lit(0)),
        lambda x: error(F.when(get(x, _SCRIPT, 1) != "", "parse_error").otherwise("runtime_error"), get(x, _SCRIPT, 2), get(x, _SCRIPT, 5), get(x, _SCRIPT, 3), base(get(x, _SCRIPT, 4))),
    )
    loads = F.transform(F.regexp_extract_all(output, F.lit(_LOAD), F.lit(0)), lambda x: error(F.lit("parse_error"), get(x, _LOAD, 2), zero, none, base(get(x, _LOAD, 1))))
    fresh = F.filter(loads, lambda x, i: ~F.exists(F.concat(scripts, F.slice(loads, 1, i)), lambda y: y["file"] == x["file"]))
    own = F.concat(scripts, fresh)
    others = F.transform(F.regexp_extract_all(output, F.lit(_ENGINE), F.lit(1)), lambda m: error(F.lit("error"), m, zero, none, none))
    noisy = lambda x: F.exists(F.array(*[F.lit(n.lower()) for n in NOISE]), lambda n: F.contains(F.lower(x["message"]), n))
    errors = F.when(F.size(own) > 0, own).otherwise(F.filter(others, lambda x: ~noisy(x)))
    has = lambda kind: F.exists(errors, lambda x: x["kind"] == kind)
    status = F.when(has("parse_error"), "parse_error").when(has("runtime_error"), "runtime_error").when((F.size(errors) > 0) | (returncode != 0) | returncode.isNull(), "error").otherwise("ok")
    return F.struct(status.alias("status"), errors.alias("errors"))


# The sentences of a prompt for a source file, and words before a bracket that are no functions.
_ASK = "Write the complete C++17 source file for `{}` — a self-contained file that compiles with `g++ -std=c++17 -fsyntax-only` alone."
_MAIN = "It is a complete runnable program (it has main())."
_END = "Your reply must include the file's #include lines. No TODOs, no placeholders, no example usage."
_WORDS = ("if", "for", "while", "switch", "return", "catch")
_TYPE = r"(?m)^\s*(?:class|struct)\s+(\w+)"
_FUNCTION = r"(?m)^(?!#|\s)[\w:<>&*\s~]*?\b(\w+)\s*\((?:[^()]++|\([^()]*+\))*+\)\s*(?:const\s*)?(?:noexcept\s*)?\{"


def source_prompt(code: Column, path: Column) -> Column:
    """What to ask for so that a reply defines the types and functions of ``code``."""
    before, after = _ASK.split("{}")
    types = F.slice(F.regexp_extract_all(code, F.lit(_TYPE), F.lit(1)), 1, 10)
    found = F.filter(F.regexp_extract_all(code, F.lit(_FUNCTION), F.lit(1)), lambda x: ~x.isin(*_WORDS))
    functions = F.slice(F.array_distinct(found), 1, 16)
    lines = [
        F.concat(F.lit(before), path, F.lit(after)),
        F.when(F.contains(code, F.lit("int main(")), _MAIN),
        F.when(F.size(types) > 0, F.concat(F.lit("Types to define: "), F.array_join(types, ", "))),
        F.when(F.size(functions) > 0, F.concat(F.lit("Functions it defines: "), F.array_join(functions, ", "))),
        F.lit(_END),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def judged(code: Column, run: Column, status: Column, stdout: Column, expect: Column, must: Column, must_not: Column, bad: Column) -> Column:
    """(parses, builds, output, api, no_bad, correct): a run is right if its output, blanks squeezed, holds what is expected."""
    low = F.lower(code)
    ran = F.coalesce(run, F.lit(False))
    parses = F.when(ran, status.isin("ok", "runtime_error")).otherwise(status == "ok")
    builds = F.when(ran, status != "runtime_error").otherwise(status == "ok")
    said = F.when(ran, F.contains(F.lower(T.squeezed(F.coalesce(stdout, F.lit("")))), F.lower(expect)))
    api = F.forall(must, lambda x: F.contains(low, F.lower(x)))
    clean = ~bad & ~F.exists(must_not, lambda x: F.contains(low, F.lower(x)))
    correct = parses & builds & F.coalesce(said, F.lit(True)) & api & clean
    return F.struct(parses.alias("parses"), builds.alias("builds"), said.alias("output"), api.alias("api"), clean.alias("no_bad"), correct.alias("correct"))


MAX_EDITS = 16
_EDITS = r"(?s)```(?:edits|json)\s*\n(.*)```"


def edit_block(reply: Column, most: int = MAX_EDITS) -> Column:
    """(ops, error): the edits of a reply's fenced JSON array, each as JSON text; raw line ends within strings are let pass."""
    body = T.stripped(F.regexp_extract(reply, _EDITS, 1))
    ops = F.from_json(body, "array<string>", {"allowUnquotedControlChars": "true"})
    error = (
        F.when(~reply.rlike(_EDITS), "no block of edits")
        .when(ops.isNull() & ~F.startswith(body, F.lit("[")) & F.get_json_object(F.concat(F.lit('{"x":'), body, F.lit("}")), "$.x").isNotNull(), "not an array")
        .when(ops.isNull(), "not valid JSON")
        .when(F.size(ops) > most, "too many edits")
    )
    return F.struct(F.when(error.isNull(), ops).alias("ops"), error.alias("error"))


def edited(sections: Column, ops: Column) -> Column:
    """(sections, errors) after a fold over ``ops``, an array of (op, section, text, find).

    ``set`` puts a section's text, ``append`` and ``file_code`` add to it after a blank
    line, ``replace`` and ``delete`` change the first place where ``find`` stands,
    ``delete_section`` empties it but keeps its place. An edit that can't be made is passed
    over and gives the number of the edit and the reason.
    """
    start = F.struct(sections.alias("sections"), F.expr("cast(array() as array<string>)").alias("errors"), F.lit(0).alias("n"))

    def step(s, e):
        op, name, find = e["op"], e["section"], e["find"]
        held, text = s["sections"], e["text"]
        old = F.coalesce(F.try_element_at(held, name), F.lit(""))
        there = F.map_contains_key(held, F.coalesce(name, F.lit("")))
        at = F.when(there & find.isNotNull(), F.instr(old, find)).otherwise(0)
        error = (
            F.when(op.isNull() | ~op.isin("file_code", "set", "append", "replace", "delete", "delete_section"), "unknown op")
            .when(name.isNull() | (name == ""), "no section")
            .when(op.isin("set", "append", "file_code") & text.isNull(), "no text")
            .when((op == "replace") & find.isNull() | (op == "delete") & (find.isNull() | (find == "")), "nothing to find")
            .when(op.isin("replace", "delete") & ~there, "no such section")
            .when(op.isin("replace", "delete") & (at == 0) & (find != ""), "not found")
        )
        swap = F.when(op == "replace", F.coalesce(text, F.lit(""))).otherwise("")
        cut = F.concat(F.substring(old, F.lit(1), F.greatest(at, F.lit(1)) - 1), swap, F.substring(old, F.greatest(at, F.lit(1)) + F.length(find), F.length(old)))
        new = F.when(op == "set", text).when(op.isin("append", "file_code"), T.stripped(F.concat(old, F.lit("\n\n"), text))).when(op == "delete_section", "").otherwise(cut)
        put = F.when(there, F.transform_values(held, lambda k, v: F.when(k == name, new).otherwise(v))).otherwise(F.map_concat(held, F.create_map(F.coalesce(name, F.lit("")), new)))
        return F.struct(
            F.when(error.isNull(), put).otherwise(held).alias("sections"),
            F.when(error.isNull(), s["errors"]).otherwise(F.concat(s["errors"], F.array(F.concat(s["n"].cast("string"), F.lit(": "), error)))).alias("errors"), (s["n"] + 1).alias("n"),
        )

    return F.aggregate(ops, start, step, lambda s: F.struct(s["sections"].alias("sections"), s["errors"].alias("errors")))


def filed(calls: DataFrame, group: str, order: list[str], name: str, out: str, most: int, head: int = 240) -> DataFrame:
    """``calls`` with ``entry`` (its number), ``stub`` (what stays in the history) and ``kept``.

    Each output is filed under its number in its group. The newest entries stay as long as
    together they have at most ``most`` characters; older ones leave only a note of their size.
    """
    w = Window.partitionBy(group).orderBy(*order)
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    marked = calls.withColumn("entry", F.concat(F.lit("tool-"), F.row_number().over(w).cast("string"))).withColumn("_upto", F.sum(F.length(out)).over(newest))
    size = F.length(out).cast("string")
    stub = F.concat(F.regexp_replace(F.substring(out, 1, head), r"\s+$", ""), F.lit("\n[filed as "), F.col("entry"), F.lit(", "), size, F.lit(" characters]"))
    gone = F.concat(F.lit("[pruned "), size, F.lit(" characters: "), F.col("entry"), F.lit(" "), F.col(name), F.lit("]"))
    return marked.withColumn("stub", F.when(F.col("_upto") <= most, stub).otherwise(gone)).withColumn("kept", F.col("_upto") <= most).drop("_upto")


def check_list(passed: dict[str, Column]) -> Column:
    """``name:p`` or ``name:f`` of each named check, joined by spaces."""
    return F.concat_ws(" ", *[F.concat(F.lit(name), F.when(F.coalesce(ok, F.lit(False)), ":p").otherwise(":f")) for name, ok in passed.items()])


def recalled(reply: Column, parses, marker: str) -> Column:
    """ok, ok_bare_sections, or why a reply that should recall three files fails.

    With three fenced blocks or more, all must parse and the first hold the marker; with
    fewer, two sections under headings must parse and one of them hold it. ``parses`` maps
    a block's text to a boolean column.
    """
    blocks = F.regexp_extract_all(reply, F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1))
    parts = F.filter(F.transform(F.split(reply, r"(?m)^## ", -1), T.stripped), lambda x: x != "")
    bodies = F.transform(F.filter(parts, lambda x: F.contains(x, F.lit("\n"))), lambda x: F.regexp_replace(F.substring(x, F.instr(x, F.lit("\n")) + 1, F.length(x)), r"^[\n`]+|[\n`]+\z", ""))
    clean = F.filter(bodies, lambda x: (x != "") & parses(x))
    has = lambda x: F.contains(F.lower(x), F.lit(marker))
    fenced = F.when(F.exists(blocks, lambda x: ~parses(x)), "recall_block_fail").when(~has(blocks[0]), "recall_player_missing").otherwise("ok")
    bare = F.when((F.size(clean) >= 2) & F.exists(clean, has), "ok_bare_sections").otherwise("recall_fail")
    return F.when(F.size(blocks) >= 3, fenced).otherwise(bare)


def tool_schema(name: Column, description: Column, kind: Column, properties: Column, required: Column) -> Column:
    """A tool's descriptor in which each required property says so itself; schemas that are no objects have no properties.

    ``properties`` maps a name to its specification's JSON text.
    """
    flagged = F.transform_values(properties, lambda k, v: F.when(F.array_contains(F.coalesce(required, F.expr("cast(array() as array<string>)")), k), F.regexp_replace(v, r"\}\s*\z", F.when(v.rlike(r"^\s*\{\s*\}\s*$"), '"required":true}').otherwise(',"required":true}'))).otherwise(v))
    props = F.when(kind == "object", F.coalesce(flagged, F.expr("cast(map() as map<string, string>)"))).otherwise(F.expr("cast(map() as map<string, string>)"))
    return F.struct(F.lit("function").alias("type"), name.alias("name"), F.coalesce(description, F.lit("")).alias("description"), props.alias("properties"))


def capped_by_batch(rows: DataFrame, group: str, order: list[str], batch: int, most: int, counts: Column) -> DataFrame:
    """Rows of each group batch by batch, until a batch ends with ``most`` counted rows or more; that batch is whole.

    Rows are numbered by a window over the group; the cap itself is met on sums of batches.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    placed = rows.withColumn("_batch", F.floor(place / batch))
    sums = placed.groupBy(group, "_batch").agg(F.sum(counts.cast("int")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sums.withColumn("_before", before).where(F.col("_before") < most).select(group, "_batch"), [group, "_batch"], "left_semi").drop("_batch")


def task_table(spark, tasks: list[dict]) -> DataFrame:
    """Tasks declared in a program as a table; what a task leaves out is not run, empty or null."""
    rows = [(t["id"], t["prompt"], list(t.get("must", ())), list(t.get("must_not", ())), bool(t.get("run", False)), t.get("expect")) for t in tasks]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("two tasks share an id")
    return spark.createDataFrame(rows, "id string, prompt string, must array<string>, must_not array<string>, run boolean, expect string")
