"""Removal of line runs that repeat earlier lines, by winnowing (operator 6, native).

Lines are compared after trimming blanks; blank lines take no part and stay. The
words of a line are its pieces between runs of blanks (tabs and other ASCII
blanks as well as spaces). A *window* is the shortest
stretch of consecutive lines that starts (or ends) at a line and has
``min_words`` words or more. Each window selects the least of its line hashes as
a fingerprint, so any two equal runs of ``min_words`` words or more have a
fingerprint in common (the guarantee of winnowing). Only windows whose
fingerprint was selected at two places or more are looked at further. They are
joined on fingerprint and content to the earliest place (doc_id, position) of
that content; a window that stands elsewhere is a repeat. Windows that start at
a line extend a match to the right and windows that end at a line extend it to
the left, a line at a time, so the union of the repeated windows is exactly the
set of lines that lie in a run of ``min_words`` words or more which also occurs
at an earlier place. Those lines are deleted.

Line rows carry two 64-bit hashes and no text. Hot fingerprints and contents are
met by grouped minima (combined before the shuffle) and by joins on the key
alone, which may be split. A document's own lines come from one row.

Defined cases: null text has no lines and stays null; an empty text has one blank
line and stays; a document that loses all its lines gets the text '' and
``emptied``; of equal runs the one at the smallest (doc_id, position) stays; rows
that repeat doc_id and text are one document; null doc_ids sort first; a text of any
length is taken whole; an empty table gives no rows; columns beside doc_id and text
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import scratch

MIN_WORDS = 50
_DOC = ["_doc", "_th"]
_WORD = r"[^\x20\x09-\x0D]+"


def _split_lines(text: str = "text") -> Column:
    return F.split(text, "\n", -1)


def _lines(docs: DataFrame) -> DataFrame:
    """(_doc, _th, pos, h, g, w, upto, n): all lines; n numbers those with words, upto sums their words."""
    each = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_th"), F.posexplode(_split_lines()).alias("pos", "line"))
    each = each.withColumn("line", F.expr(r"trim(both ' \t\r' from line)"))
    words = F.regexp_count("line", F.lit(_WORD)).cast("int")
    each = each.select(*_DOC, "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), words.alias("w"))
    order = Window.partitionBy(*_DOC).orderBy("pos")
    each = each.withColumn("again", F.lag("pos").over(order) == F.col("pos")).where("again is null or not again").drop("again")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("upto", F.sum("w").over(sofar).cast("int")).withColumn("n", F.sum((F.col("w") > 0).cast("int")).over(sofar).cast("int"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(_doc, _th, first, last, f, k1, k2): the windows that start and that end at each line with words."""
    lines = lines.where("w > 0").withColumn("before", F.col("upto") - F.col("w"))
    ahead = Window.partitionBy(*_DOC).orderBy("before").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy(*_DOC).orderBy("upto").rangeBetween(-(min_words - 1), 0)

    def of(frame) -> Column:
        body = F.collect_list(F.struct("n", "h", "g")).over(frame)
        return F.struct(F.min("n").over(frame).alias("first"), F.max("n").over(frame).alias("last"), F.min("h").over(frame).alias("f"), F.sum("w").over(frame).alias("words"), body.alias("body"))

    each = lines.select(*_DOC, F.array(of(ahead), of(behind)).alias("ws")).select(*_DOC, F.explode("ws").alias("x"))
    body = F.expr("transform(array_sort(x.body), y -> struct(y.h, y.g))")
    each = each.where(F.col("x.words") >= min_words)
    return each.select(*_DOC, "x.first", "x.last", "x.f", F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2")).distinct()


def line_marks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_doc, _th, pos, w, gone) for all lines of the documents that lose a line."""
    lines = scratch.keep(_lines(docs), "lines")
    windows = scratch.keep(_windows(lines, min_words), "windows")
    shared = windows.groupBy("f").agg(F.count("*").alias("m")).where("m > 1").select("f")
    candidates = windows.join(shared, "f", "left_semi")
    place = F.struct("_doc", "_th", "first")
    earliest = candidates.groupBy("f", "k1", "k2").agg(F.min(place).alias("place"))
    repeats = candidates.join(earliest, ["f", "k1", "k2"]).where(~place.eqNullSafe(F.col("place")))
    spots = repeats.select(*_DOC, F.explode(F.sequence("first", "last")).alias("n")).distinct().withColumn("gone", F.lit(True))
    spots = scratch.keep(spots, "spots")
    here = (F.col("l._doc").eqNullSafe(F.col("s._doc"))) & (F.col("l._th") == F.col("s._th"))
    some = spots.select(*_DOC).distinct()
    own = lines.alias("l").join(some.alias("s"), here, "left_semi")
    return own.alias("l").join(spots.alias("s"), here & (F.col("l.n") == F.col("s.n")) & (F.col("l.w") > 0), "left").select("l._doc", "l._th", "pos", "w", F.coalesce("gone", F.lit(False)).alias("gone"))


def _own_names(docs: DataFrame) -> list[str]:
    """Names by place for all columns but doc_id and text, so that none can clash with a helper's."""
    return [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text rewritten, plus ``n_lines, n_removed, words_removed, emptied``."""
    names, inner = docs.columns, docs.toDF(*_own_names(docs))
    marks = line_marks(inner.select("doc_id", "text"), min_words).groupBy(*_DOC).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "gone"))), lambda x: x["gone"]).alias("_gone"),
        F.sum(F.when(F.col("gone"), 1).otherwise(0)).alias("_removed"),
        F.sum(F.when(F.col("gone"), F.col("w")).otherwise(0)).alias("_words"),
    )
    joined = inner.withColumn("_key", F.xxhash64("text")).join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_th")), "left")
    rest = F.transform(F.filter(F.arrays_zip(_split_lines().alias("l"), F.col("_gone").alias("g")), lambda x: ~x["g"]), lambda x: x["l"])
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    columns = [text.alias(c) if c == "text" else F.col(c) for c in inner.columns]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_split_lines())).cast("long")
    with_words = F.length(F.translate(text, " \t\n\x0b\f\r", "")) > 0
    return joined.select(
        *columns, n_lines.alias("n_lines"), F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_words", F.lit(0)).cast("long").alias("words_removed"), (F.col("_gone").isNotNull() & ~with_words).alias("emptied"),
    ).toDF(*names, "n_lines", "n_removed", "words_removed", "emptied")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines deleted; documents of which nothing is left go.

    ``n_chars``, where the table has it, follows the new text.
    """
    inner = docs.toDF(*_own_names(docs))
    done = deduplicate_lines(inner, min_words).where("not emptied")
    columns = [F.col(c) for c in inner.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        columns[at] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[at].dataType)).otherwise(columns[at])
    return done.select(*columns).toDF(*docs.columns)
