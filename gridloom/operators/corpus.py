"""Curation of documents: filters, first-seen rows, blocks, packing and trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.grid import let
from gridloom.functions.text import stripped

# Licence names of which one must be part of a file's list.
LICENSES = ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "0BSD", "ISC", "BSL-1.0", "Unlicense", "CC0-1.0", "zlib", "MIT-0", "BSD-Clause", "mit", "apache-2.0", "bsd-3-clause", "bsd-2-clause")
# What a missing column counts as.
DEFAULTS = {"avg_line_length": 40.0, "max_line_length": 80, "alphanum_fraction": 0.5}


def keep_first(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first row of each content: minima are combined before the shuffle, so a hot content is no hot task."""
    key = F.sha2(F.col(content).cast("binary"), 256)
    first = rows.groupBy(key.alias("_k")).agg(F.min(F.struct(*order)).alias("_o"))
    return rows.withColumn("_k", key).join(first, "_k").where(F.struct(*order).eqNullSafe(F.col("_o"))).drop("_k", "_o")


def quality_filter(files: DataFrame) -> DataFrame:
    """Size, licence and line statistics. Columns that are absent take defaults; nulls are refused.

    Plans work out an expression that stands twice before a filter's first condition, so the
    statistics are behind a WHEN: they are met for texts of the right size only.
    """
    have = files.columns
    get = lambda c: F.col(c) if c in have else F.lit(DEFAULTS[c])
    sized = F.col("content").isNotNull() & F.col("size").between(300, 8000)
    rows = files.where(sized)
    if "licenses" in have:
        named = F.array_join("licenses", " ")
        rows = rows.where(F.exists(F.array(*[F.lit(x) for x in LICENSES]), lambda x: F.contains(named, x)))
    bad = (get("avg_line_length") > 200) | (get("max_line_length") > 1000) | ~let(get("alphanum_fraction"), lambda x: x.between(0.25, 0.95))
    return rows.where(F.when(sized, F.coalesce(~bad, F.lit(False))).otherwise(F.lit(False)))


def fenced_blocks(lines: DataFrame, group: str, order: str, is_fence, line: str) -> DataFrame:
    """(group, block, lines, text): lines between the 1st and 2nd, 3rd and 4th.. fence; an unclosed block is dropped."""
    w = Window.partitionBy(group).orderBy(order)
    marked = lines.withColumn("_f", F.when(is_fence, 1).otherwise(0)).withColumn("_n", F.sum("_f").over(w))
    total = marked.groupBy(group).agg(F.sum("_f").alias("_t"))
    inside = marked.where((F.col("_f") == 0) & (F.col("_n") % 2 == 1)).join(total, group).where("_n < _t")
    ordered = F.array_sort(F.collect_list(F.struct(order, line)))
    blocks = inside.groupBy(group, ((F.col("_n") - 1) / 2).cast("long").alias("block")).agg(F.count("*").alias("lines"), ordered.alias("_x"))
    return blocks.select(group, "block", "lines", F.array_join(F.transform("_x", lambda x: x[line]), "\n").alias("text"))


def trim_context(turns: DataFrame, limit: int) -> DataFrame:
    """Turns kept when the oldest go until at most ``limit`` characters are left; system turns and the last turn stay."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    fixed = F.sum(F.when(F.col("role") == "system", F.length("text")).otherwise(0)).over(Window.partitionBy("conv_id"))
    later = F.sum(F.when(F.col("role") != "system", F.length("text")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = turns.withColumns({"_later": later + fixed, "_back": F.row_number().over(w)})
    return marked.where((F.col("role") == "system") | (F.col("_back") == 1) | (F.col("_later") <= limit)).drop("_later", "_back")


def pack(rows: DataFrame, group: str, order: str, size, most: int, width: int = 4096) -> DataFrame:
    """The rows of each group up to and with the one that brings the running size to ``most``, by a numeric order.

    Sizes are summed over ranges of the order first; only the range in which a group's
    running size passes ``most`` is looked at row by row, so no task holds a group.
    """
    ranged = rows.withColumns({"_r": F.floor(F.col(order) / width), "_s": size})
    sums = ranged.groupBy(group, "_r").agg(F.sum("_s").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sums.select(group, "_r", before.alias("_before")).where(F.col("_before") < most)
    inner = F.coalesce(F.sum("_s").over(Window.partitionBy(group, "_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(open_, [group, "_r"]).withColumn("_b", F.col("_before") + inner).where(F.col("_b") < most).drop("_b", "_r", "_s", "_before")


# The lines of a project dump.
_NAME, _VERSION = r"(?md)^### Name:[^\S\n]*(.*)$", r"(?md)^### Godot version:[^\S\n]*(.*)$"
_BODY = r"(?md)^### Files:"
_FILE = r"(?md)^File name:[^\S\n]*([^\n]*)\n(?:[^\S\n]*\n)*+```(\w*)[^\S\n]*(?:\n|\z)((?s:.*?))(^```\w*[^\S\n]*$|\z)"


def parse_dumps(dumps: DataFrame) -> DataFrame:
    """(name, version, path, lang, content) of every file of the project dumps ``dumps(value)``.

    A dump has header lines, then from ``### Files:`` on files: a line ``File name:``
    and, after blank lines at most, a fenced block up to the next fence or the end of
    the text. A name without a block is no file; a block may be empty; of blocks of one
    name the last counts. A header that is missing or empty is '?', and of repeated ones
    the last counts. All in the JVM: a pattern cuts a dump into its files.
    """
    cut = dumps.select("value", F.regexp_instr("value", F.lit(_BODY)).alias("_at"))
    parts = cut.select(F.expr("if(_at > 0, left(value, _at - 1), value)").alias("head"), F.expr("if(_at > 0, substr(value, _at), '')").alias("body"))
    last = lambda pattern: F.coalesce(F.nullif(stripped(F.try_element_at(F.regexp_extract_all("head", F.lit(pattern), F.lit(1)), F.lit(-1))), F.lit("")), F.lit("?"))
    piece = lambda x, group: F.regexp_extract(x, _FILE, group)
    file = lambda x: F.struct(stripped(piece(x, 1)).alias("path"), piece(x, 2).alias("lang"), F.when(piece(x, 4) == "", piece(x, 3)).otherwise(F.regexp_replace(piece(x, 3), r"\n\z", "")).alias("content"))
    found = parts.select(last(_NAME).alias("name"), last(_VERSION).alias("version"), F.transform(F.regexp_extract_all("body", F.lit(_FILE), F.lit(0)), file).alias("files"))
    later = F.filter("files", lambda x, i: ~F.exists(F.slice("files", i + 2, F.size("files")), lambda y: y["path"] == x["path"]))
    return found.select("name", "version", F.explode(later).alias("f")).select("name", "version", "f.*")


def resolved_classes(files: DataFrame, defines: str, uses: str) -> DataFrame:
    """(project, resolved): of ``files(project, code)`` the projects in which a class that one file uses is defined by a file of the same project.

    Names are met as distinct (project, name) rows, so a large project is many keys.
    """
    names = lambda pattern: files.select("project", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(pattern), F.lit(1)))).alias("name")).distinct()
    both = names(uses).join(names(defines), ["project", "name"], "left_semi")
    return both.groupBy("project").agg(F.array_sort(F.collect_list("name")).alias("resolved"))


def repeated_calls(calls: DataFrame, group: str, order: str, name: str, arguments: str) -> DataFrame:
    """``calls`` with ``again``: whether an earlier call of the group has the same name and, as objects, the same arguments.

    Arguments are JSON; their entries are sorted by key, so order and blanks don't count.
    """
    entries = F.array_sort(F.map_entries(F.from_json(arguments, "map<string, string>")))
    signature = F.coalesce(F.to_json(entries), F.col(arguments))
    w = Window.partitionBy(group, name, "_signature").orderBy(order)
    return calls.withColumn("_signature", signature).withColumn("again", F.row_number().over(w) > 1).drop("_signature")
