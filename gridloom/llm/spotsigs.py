"""SpotSigs document fingerprints (operator 3, native).

Spots are places after a common word of English, French, German or Spanish; a
signature is the chain of the ``CHAIN`` content words that follow (common words
between them are passed over). The start of a text is a spot too (its first
content word alone is a signature as well), and so are the content words whose hash falls in one of ``CELL`` cells, which gives spots to
texts without common words. A text's fingerprint is the sorted set of its
32-bit signature hashes; likeness is the Jaccard similarity of two sets.

``near_pairs`` compares all documents: sets are partitioned by their length in
bands, a pair is looked for only within the bands that its similarity allows,
under its rarest signatures (a prefix), and lengths are tested before sets.

Defined cases: null text is empty; an empty text's fingerprint is '' and its
likeness is 1 to another empty one and 0 to any other; a text without a word has
its whole content as its one signature; a last document is followed by the
first, a single one by itself; repeated doc_ids follow each other by text, null ones
come first; a text of any length is taken whole; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN, CELL, BUCKET = 2, 8, 256
# The anchors, common words of four languages.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour qui que sa se ses son sur un une vous "
    "aber als am auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich ihr im ist mit nach nicht noch oder sich sie sind so um und von vor war wie wird zu zum zur "
    "al como con del el era es esta este la las lo los más muy no o para pero por que se si sin su sus un una y"
)


def _anchor_pattern() -> str:
    """The anchors as one pattern, branched by first letter: a whole word and the space after it.

    Runs of anchors are met one by one: a repeated group would recurse in Java's matcher.
    """
    by: dict[str, list[str]] = {}
    for word in sorted(set(ANCHORS.split())):
        by.setdefault(word[0], []).append(word[1:])
    one = "|".join(f"{head}(?:{'|'.join(sorted(rests, key=lambda r: (-len(r), r)))})" for head, rests in sorted(by.items()))
    return f"(?<= )(?:{one}) "


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signature hashes."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    marked = F.trim(F.concat(F.lit("#"), F.ltrim(F.regexp_replace(words, _anchor_pattern(), "#"))))
    content = F.split(F.regexp_replace(marked, "#+", "#"), " ")
    padded = F.concat(content, F.array_repeat(F.lit(""), chain - 1))
    rows = F.arrays_zip(padded.alias("w"), *[F.slice(padded, k + 1, F.size(content)).alias(f"w{k}") for k in range(1, chain)])
    spots = F.filter(rows, lambda x: x["w"].startswith("#") | (F.pmod(F.xxhash64(x["w"]), F.lit(CELL)) == 0))
    made = F.transform(spots, lambda x: F.xxhash64(F.translate(x["w"], "#", ""), *[F.translate(x[f"w{k}"], "#", "") for k in range(1, chain)]).bitwiseAND(F.lit(0xFFFFFFFF)))
    first = F.xxhash64(F.translate(content[0], "#", "")).bitwiseAND(F.lit(0xFFFFFFFF))
    made = F.concat(made, F.array(first))
    has = F.length(F.trim(words)) > 0
    return F.when(F.length(text) == 0, F.array().cast("array<long>")).when(has, F.array_sort(F.array_distinct(F.filter(made, lambda x: x.isNotNull())))).otherwise(F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; sets without a common signature, or empty ones, are settled by size first."""
    common = F.size(F.array_intersect(a, b))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(none, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, derive, bucket: int = BUCKET) -> DataFrame:
    """``derive(docs)`` of ``docs(doc_id, text)`` with ``next``, the struct of the same of the document with the next doc_id; the last one's is the first.

    Documents go to ranges of ids of about ``bucket`` documents each, the only shuffle
    of texts. A range's first document is passed to the range before it.
    """
    span = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).first()
    low, width = span.a or 0, max(1, -(-((span.b or 0) - (span.a or 0) + 1) // max(1, -(-span.n // bucket))))
    key = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1))
    order = Window.partitionBy("_b").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    keyed = docs.withColumn("_b", key)
    rows = derive(keyed)
    body = F.struct(*[c for c in rows.columns if c not in ("doc_id", "_b")])
    rows = rows.withColumn("_next", F.lead(body).over(order))
    # the range after each range: by ids alone, in two levels, so that no task sees all ranges
    ranges = docs.select(key.alias("_b")).distinct().withColumn("_g", F.floor(F.col("_b") / 4096))
    inner = Window.partitionBy("_g").orderBy("_b")
    ranges = ranges.withColumn("_before", F.lag("_b").over(inner))
    groups = ranges.groupBy("_g").agg(F.max("_b").alias("_last")).withColumn("_prior", F.lag("_last").over(Window.orderBy("_g")))
    end = ranges.agg(F.max("_b")).first()[0]
    before = ranges.join(groups, "_g").select(F.col("_b").alias("_from"), F.coalesce("_before", "_prior", F.lit(end)).alias("_b"))
    heads = derive(keyed.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn"))
    heads = heads.select(F.col("_b").alias("_from"), body.alias("_head")).join(before, "_from").drop("_from")
    return rows.join(heads, "_b").withColumn("next", F.coalesce("_next", "_head")).drop("_b", "_next", "_head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness (see the query's contract)."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(own, lambda rows: rows.withColumn("sigs", signatures(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    both = both.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next.sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of distinct fingerprint classes that are ``threshold`` alike or more, as their smallest doc_ids."""
    sets = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("s")).where("size(s) > 0")
    sets = sets.groupBy("s").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("s"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9)
    each = sets.select("id", "n", band.alias("band"), F.explode("s").alias("g"))
    rare = each.groupBy("g").agg(F.count("*").alias("df"))
    ordered = each.join(rare, "g").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "g")))
    prefix = ordered.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    y = prefix.select(F.col("g"), F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("id").alias("b"), F.col("n").alias("nb"))
    x = prefix.select("g", "band", F.col("id").alias("a"), F.col("n").alias("na"))
    alike = (F.col("nb") <= F.col("na")) & ((F.col("nb") < F.col("na")) | (F.col("a") < F.col("b"))) & (F.col("nb") >= F.col("na") * threshold)
    found = x.join(y, ["g", "band"]).where(alike).select("a", "b").distinct()
    full = found.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
