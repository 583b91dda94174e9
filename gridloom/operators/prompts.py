"""Prompts made from code, tool messages read from logs, and replies taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What declares a script's base, name, remarks, signals, exported variables and methods.
SCRIPT = {"base": r"(?m)^extends[ \t]+(\S.*?)[ \t]*$", "name": r"(?m)^class_name[ \t]+(\w+)", "remark": r"(?m)^##[ ]?(.*)$", "signal": r"(?m)^[ \t]*signal[ \t]+(\w+)", "export": r"(?m)^[ \t]*@export\w*[ \t]+var[ \t]+(\w+)", "method": r"(?m)^[ \t]*(?:static[ \t]+)?func[ \t]+(.+?):[ \t]*$"}


def captures(code: Column, pattern: str, most: int) -> Column:
    """The first ``most`` captures, trimmed, none empty."""
    got = F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
    return F.slice(F.filter(got, lambda x: x != ""), 1, most)


def _line(label: str, items: Column, sep: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, sep)))


def script_prompt(code: Column, path: Column) -> Column:
    """A request for a file from what the file declares; absent parts leave no line."""
    base, name = F.regexp_extract(code, SCRIPT["base"], 1), F.regexp_extract(code, SCRIPT["name"], 1)
    remarks = F.array_join(captures(code, SCRIPT["remark"], 6), " ")
    parts = [
        F.concat(F.lit("File: "), path), F.when(base != "", F.concat(F.lit("Base: "), base)), F.when(name != "", F.concat(F.lit("Class: "), name)),
        F.when(remarks != "", F.concat(F.lit("Purpose: "), F.substring(remarks, 1, 400))),
        _line("Signals: ", captures(code, SCRIPT["signal"], 12), ", "), _line("Exports: ", captures(code, SCRIPT["export"], 12), ", "), _line("Methods: ", captures(code, SCRIPT["method"], 24), "; "),
    ]
    return F.concat_ws("\n", *parts)


def samples(files: DataFrame, system: str) -> DataFrame:
    """(id, project, path, chars, messages) of ``files(project, path, code)``."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(message("system", F.lit(system)), message("user", script_prompt(F.col("code"), F.col("path"))), message("assistant", F.col("code")))
    return files.select(F.concat_ws("::", "project", "path").alias("id"), "project", "path", F.length("code").alias("chars"), messages.alias("messages"))


def asked_again(rows: DataFrame) -> DataFrame:
    """Samples whose request is made anew from the stored reply."""
    again = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", script_prompt(F.element_at("messages", -1)["content"], F.col("path"))).otherwise(m["content"]).alias("content")))
    return rows.withColumn("messages", again)


_BLOCK = r"(?m)^SCRIPT ERROR: (.*)\n\s+at: \S+ \((res://[^:)]+):(\d+)\)"


def error_blocks(logs: DataFrame) -> DataFrame:
    """(id, file, line, message) of the error blocks of ``logs(id, log)``."""
    parts = [F.regexp_extract_all("log", F.lit(_BLOCK), F.lit(k)) for k in (1, 2, 3)]
    rows = logs.select("id", F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("m", "f", "l"))])).alias("x"))
    return rows.select("id", F.col("x.f").alias("file"), F.col("x.l").cast("int").alias("line"), F.trim("x.m").alias("message"))


def compiler_verdict(stderr: Column, code: Column) -> Column:
    """ok; context with up to 3 missing includes; else error with up to 3 messages of 160 characters."""
    missing = F.slice(F.regexp_extract_all(stderr, F.lit(r"fatal error: ([^:\n]+): No such file"), F.lit(1)), 1, 3)
    errors = F.slice(F.transform(F.regexp_extract_all(stderr, F.lit(r"error: ([^\n]*)"), F.lit(1)), lambda x: F.substring(x, 1, 160)), 1, 3)
    return F.when(code == 0, F.struct(F.lit("ok").alias("status"), F.array().cast("array<string>").alias("errors"))).when(F.size(missing) > 0, F.struct(F.lit("context").alias("status"), missing.alias("errors"))).otherwise(F.struct(F.lit("error").alias("status"), errors.alias("errors")))
