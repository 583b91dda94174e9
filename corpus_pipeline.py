"""Curation of ``documents`` in five stages; each is written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept, and all but the last
return the columns of ``documents``.

Defined cases, beside those of the operators: rows with a null doc_id are judged like
any other and pass near dedup; null, empty and letterless texts go at the first
stage; rows that repeat both doc_id and text share their fate; texts of any length
are taken whole; an empty table passes as an empty one; further columns are carried
to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, chosen_path, decontam, langid, scratch, winnow
from gridloom.shipping import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go."""
    ship(spark)
    names = [c if c in ("doc_id", "text", "lang", "source") else f"c{i}" for i, c in enumerate(docs.columns)]
    inner = docs.toDF(*names)
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    rows = inner.select(key.alias("id"), "text", "lang", F.col("source").alias("host"), langid.suffix_of(F.col("source")).alias("suffix"))
    bad = scratch.keep(langid.identify(rows).where("not accepted").select("id").distinct(), "rejected")
    bad = bad.select(F.col("id.doc_id").alias("_doc"), F.col("id.h").alias("_h"))
    kept = inner.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_h")), "left_anti")
    return kept.toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of runs that occur earlier in the corpus go, and documents of which nothing is left."""
    ship(spark)
    return winnow.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    ship(spark)
    return chosen_path.drop_near_duplicates(docs, num=4, den=5, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of eight words of a benchmark item go (a shorter item: the whole of it)."""
    ship(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of the documents that are left."""
    ship(spark)
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

# Language identification is a fitted model and byte-level BPE a search over merges: SQL can't express
# them. tests/llm/test_pipeline.py holds the result against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
