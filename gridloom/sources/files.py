"""Readers and writers of row files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_FIELDS = ("text", "content", "code", "body")


def parquet_columns(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that the files have; the scan reads no others."""
    df = spark.read.parquet(path)
    return df.select([c for c in wanted if c in df.columns])


def in_order(df: DataFrame) -> DataFrame:
    """``df`` of a file source with ``file`` and ``row``: sorting by them gives the files' own order, sorted by path."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def text_field(df: DataFrame) -> str:
    """The first usual text column that is there."""
    for name in TEXT_FIELDS:
        if name in df.columns:
            return name
    raise ValueError(f"none of {TEXT_FIELDS} in {df.columns}")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of text files; undecodable bytes become U+FFFD. Sort by path where order counts."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that don't parse keep their text in ``_corrupt_record``, blank ones are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = f"{schema}, _corrupt_record string"
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows appended in a fixed column order; each part file has the header, so a folder reads as one table."""
    df.select(columns).write.mode("append").csv(path, header=True)


def matched_fields(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(name, value): the first group of each pattern in the lines of a log, as numbers."""
    lines = spark.read.text(path)
    hits = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract("value", p, 1).alias("v")) for n, p in patterns.items()])
    return lines.select(F.explode(hits).alias("x")).where("x.v <> ''").select("x.name", F.col("x.v").cast("double").alias("value"))


def hex_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of hexadecimal digits, one a line, comments after // left out."""
    words = spark.read.text(path).select(F.trim(F.substring_index("value", "//", 1)).alias("w")).where("w <> ''")
    return words.select(F.conv("w", 16, 10).cast("long").alias("word"))


def probe_lines(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tap, value) of captured lines ``v,tap,value`` and ``p,tap,value``; others are skipped."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).where("size(p) = 3 and p[0] in ('v', 'p')")
    return parts.select(F.col("p")[0].alias("kind"), F.col("p")[1].cast("int").alias("tap"), F.col("p")[2].cast("double").alias("value"))


def markdown(df: DataFrame) -> str:
    """A small result as a table for a report."""
    rows = [list(map(str, r)) for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows])


def printed_layers(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, row, scale, digits) of printed models: ``LAYER name tr= rows= cols=`` lines, each followed by its rows ``m=scale | 0.(d)0.(d)...``.

    Lines that start with # are comments. The layer of a row is the last header before it
    in its file; a row with another number of digits than its header says is an error. A
    file is read by line number in one task, as its headers say what follows.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("value <> '' and not startswith(value, '#')")
    head = F.when(F.startswith("value", F.lit("LAYER ")), F.struct("at", F.regexp_extract("value", r"^LAYER (\S+) tr=\d rows=\d+ cols=\d+$", 1).alias("name"), F.regexp_extract("value", r"cols=(\d+)$", 1).cast("int").alias("cols")))
    rows = lines.withColumn("head", F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))).where(F.startswith("value", F.lit("m=")))
    digits = F.transform(F.regexp_extract_all("value", F.lit(r"0\.\((\d+)\)"), F.lit(1)), lambda x: x.cast("int"))
    row = F.row_number().over(Window.partitionBy("file", "head.at").orderBy("at")) - 1
    out = rows.select("file", "head.name", row.alias("row"), F.regexp_extract("value", r"^m=(\S+) \| ", 1).cast("double").alias("scale"), digits.alias("digits"), "head.cols")
    checked = F.when(F.size("digits") == F.col("cols"), F.col("digits")).otherwise(F.raise_error(F.concat(F.lit("wrong number of digits in layer "), "name")).cast("array<int>"))
    return out.withColumn("digits", checked).drop("cols")
