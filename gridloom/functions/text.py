"""Column expressions over text and code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_share(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def held_out(key: Column, modulus: int = 50, bucket: int = 0) -> Column:
    """Whether the first 32 bits of the key's SHA-1 fall in the bucket."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long") % modulus == bucket


def major(version: Column) -> Column:
    """The leading number of a version, or '?'."""
    got = F.regexp_extract(version, r"^(\d+)", 1)
    return F.when(version.isNull() | (got == ""), "?").otherwise(got)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\w.-]", "_")


def short_id(key: Column) -> Column:
    return F.substring(F.md5(key.cast("binary")), 1, 12)


def stripped(x: Column) -> Column:
    """Without white space at both ends, line ends too."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


_FENCE = r"(?s)```[^\n`]*\n(.*?)```"


def first_block(reply: Column) -> Column:
    """The first fenced block, else the whole reply; trimmed."""
    return stripped(F.when(reply.rlike(_FENCE), F.regexp_extract(reply, _FENCE, 1)).otherwise(reply))


def last_block(reply: Column) -> Column:
    """The last fenced block; null without one."""
    return stripped(F.try_element_at(F.regexp_extract_all(reply, F.lit(_FENCE), F.lit(1)), F.lit(-1)))


def candidates(code: Column, prefixes: int = 3) -> Column:
    """The blocks of a reply, and beginnings and ends of each by lines; unique, in order, none empty."""
    blocks = F.regexp_extract_all(code, F.lit(_FENCE), F.lit(1))
    lines = lambda b: F.split(b, "\n", -1)
    heads = lambda b: F.transform(F.sequence(F.lit(1), F.lit(prefixes)), lambda n: F.array_join(F.slice(lines(b), 1, F.greatest(F.size(lines(b)) - n, F.lit(0))), "\n"))
    tails = lambda b: F.transform(F.sequence(F.lit(1), F.lit(prefixes)), lambda n: F.array_join(F.slice(lines(b), n + 1, F.size(lines(b))), "\n"))
    every = F.flatten(F.concat(F.array(blocks), F.transform(blocks, heads), F.transform(blocks, tails)))
    return F.filter(F.array_distinct(F.transform(every, stripped)), lambda x: x != "")


def any_match(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns found, in their order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull())


def missing_parts(text: Column, parts: Column) -> Column:
    """Those parts that the text lacks, in lower case."""
    low = F.lower(text)
    return F.filter(parts, lambda p: ~F.contains(low, F.lower(p)))


def bucket_of(message: Column, rules: dict[str, str], other: str = "other") -> Column:
    """The first rule whose pattern is found in the message."""
    out = None
    for name, pattern in rules.items():
        out = F.when(message.rlike(pattern), name) if out is None else out.when(message.rlike(pattern), name)
    return out.otherwise(other)


def verdict(messages: Column, clean: Column, context: str, broken: str) -> Column:
    """clean if it is flagged so; context if there are messages, all of the first kind and none of the second; else broken."""
    some = F.coalesce(F.size(messages) > 0, F.lit(False))
    only_context = F.forall(messages, lambda m: m.rlike(context)) & ~F.exists(messages, lambda m: m.rlike(broken))
    return F.when(clean, "clean").when(some & only_context, "context").otherwise("broken")


def masked_labels(prompt: Column, body: Column, limit: int, ignore: int = -100, pad: int | None = None) -> Column:
    """(ids, labels, used) of prompt and body within ``limit``; null where the prompt leaves fewer than 9 places.

    With ``pad`` both are filled up to ``limit``, the labels with ``ignore``.
    """
    rest = F.slice(body, 1, F.greatest(F.lit(limit) - F.size(prompt), F.lit(0)))
    used = F.size(prompt) + F.size(rest)
    more = F.greatest(F.lit(limit) - used, F.lit(0)) if pad is not None else F.lit(0)
    ids = F.concat(prompt, rest, F.array_repeat(F.lit(pad or 0), more))
    labels = F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), rest, F.array_repeat(F.lit(ignore), more))
    return F.when(F.size(prompt) < limit - 8, F.struct(ids.alias("ids"), labels.alias("labels"), used.alias("used")))


def tool_call(reply: Column) -> Column:
    """(name, arguments) of the first tagged call, else of the last JSON fence; null without either."""
    tagged = F.regexp_extract(reply, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    fenced = F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(?s)```json\s*(\{.*?\})\s*```"), F.lit(1)), F.lit(-1))
    body = F.when(tagged != "", tagged).otherwise(fenced)
    name, args = F.get_json_object(body, "$.name"), F.get_json_object(body, "$.arguments")
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(args, F.lit("{}")).alias("arguments")))
