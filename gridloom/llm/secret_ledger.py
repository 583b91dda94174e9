"""Secret scans with an incremental blob ledger (operator 10).

Every version of every file is addressed by the SHA-256 of its content. The
ledger is a Parquet table of (blob, rule version, spans). A scan takes only the
blobs that the ledger has not seen under the present rules, each content once,
appends what it finds (also that there is nothing), and joins the ledger back to
all paths and versions that hold a blob. Scanning again costs hashing only.

Spans are in code points, end exclusive. The base kinds are matched leftmost and
without overlap, each by itself; matches that are too short are dropped. Further
kinds add spans and never take one away.

Scans may race or be repeated: the same blob may then stand in the ledger twice,
with equal spans, and is read once.

Defined cases: null text is the empty blob; rows may repeat, and share one scan;
null ids are rows like any other; a text of any length is scanned whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import scratch, textbytes

RULE_VERSION = "1.1"
BASE = ("assign", "access", "hex")
# kind, pattern, group whose length counts, least length; in the order of the output
RULES = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1),
    ("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 0, 20),
    ("basic_auth", re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@"), 0, 8),
)
# A text without any of a kind's marks (in lower case) can't match it.
MARKS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "private_key": ("private key",), "web_token": ("eyj",), "basic_auth": ("://",)}


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    low, found = text.lower(), []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        marks = MARKS.get(kind)
        if marks and not any(m in low for m in marks):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end()))
    return [(start, RULES[order][0], end) for start, order, end in sorted(found)]


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for k in range(0, len(batch), 512):
            part = batch.slice(k, 512)
            spans = [[{"kind": n, "start": a, "end": b} for a, n, b in find_spans(text.as_py() or "")] for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=["blob", "spans"])


def _blob(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def update_ledger(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of ``versions(text)`` that the ledger folder has not seen under ``rule_version``; the ledger."""
    spark = versions.sparkSession
    schema = f"blob binary, rule_version string, spans {_SPANS}"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    blobs = versions.select(_blob().alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    if exists:
        seen = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == rule_version)
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    scanned = blobs.mapInArrow(textbytes.lean(_scan), f"blob binary, spans {_SPANS}")
    scanned.select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").partitionBy("rule_version").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger)


def findings(versions: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """``spans`` of every row of ``versions(doc_id, text)``: (doc_id, blob, spans)."""
    ledger = ledger or scratch.fresh(versions.sparkSession, "ledger")
    known = update_ledger(versions, ledger, rule_version).where(F.col("rule_version") == rule_version)
    known = known.groupBy("blob").agg(F.min("spans").alias("spans"))
    return versions.select("doc_id", _blob().alias("blob")).join(known, "blob").select("doc_id", "blob", "spans")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
