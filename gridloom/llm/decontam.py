"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 2).

Texts become lower-case words parted by single spaces. A pattern is a window of
``width`` consecutive words of an item, with a space at both ends (the whole
item, where it is shorter). Patterns are grouped by length, so short ones do not
spoil the shifts of long ones. In each group a shift table maps the last block
of the search window to the distance it may be moved; where that is zero, the
block's bucket of patterns, keyed by the window, selects test strings, and a
direct comparison confirms each occurrence. All occurrences are found.

The items are the stated query set. They are compiled in blocks of at most
``block_bytes`` of item text (tables take some 200 times that in each worker), each
broadcast in turn to a scan of all documents without a shuffle. Usually there is
one block; with more, a scan adds what it finds to the rows of the scan before,
which are written in between so that a worker holds one block's tables at a time.

Defined cases: null and empty texts have no words; a text of any length is scanned
whole; null or wordless items have no windows; items without an id are ignored;
items that share an id count as one; item ids are compared as strings; no items, or
no documents, is no finding; repeated rows are scanned each. Other columns of the
documents are kept, whatever their names (``find_items`` adds three of its own).
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import scratch, textbytes

WIDTH, BLOCK_BYTES = 8, 1 << 19
# A-Z become a-z; ASCII other than letters and digits becomes a space; the rest stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Group:
    """The Wu-Manber tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.window = m = min(map(len, patterns))
        self.block = b = 2 if m < 6 else 3 if m < 12 else 5 if m < 24 else 8
        b = self.block = min(b, m)
        self.far = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[bytes]]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                key = p[end - b : end]
                if m - end < self.shift.get(key, self.far):
                    self.shift[key] = m - end
            self.bucket.setdefault(p[m - b : m], {}).setdefault(p[:m], []).append(p)

    def find(self, text: bytes):
        """(offset, pattern) of every occurrence."""
        at, end, get, m, b, far = self.window, len(text), self.shift.get, self.window, self.block, self.far
        while at <= end:
            move = get(text[at - b : at], far)
            if move:
                at += move
                continue
            for p in self.bucket[text[at - b : at]].get(text[at - m : at], ()):
                if text.startswith(p, at - m):
                    yield at - m, p
            at += 1


class Matcher:
    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width = width
        self.of: dict[bytes, list[str]] = {}
        self.total: dict[str, set[bytes]] = {}
        for item, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - width + 1) if words else 0):
                p = b" " + b" ".join(words[k : k + width]) + b" "
                owners = self.of.setdefault(p, [])
                if item not in owners:
                    owners.append(item)
                self.total.setdefault(item, set()).add(p)
        classes: dict[int, list[bytes]] = {}
        for p in self.of:
            classes.setdefault(min(len(p).bit_length(), 6), []).append(p)
        self.groups = [Group(ps) for ps in classes.values()]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], dict[str, set[bytes]]]:
        """The number of words, the hit word ranges (first, end), and the patterns found of each item."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        found = [hit for group in self.groups for hit in group.find(line)]
        if not found:
            return len(words), [], {}
        found.sort()
        spans, items, at, count = [], {}, 0, 0
        for start, p in found:
            count += line.count(b" ", at, start)
            at = start
            last = count + p.count(b" ") - 1
            if spans and count <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], last))
            else:
                spans.append((count, last))
            for item in self.of[p]:
                items.setdefault(item, set()).add(p)
        return len(words), spans, items


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items, width: int) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items.value, width)
    return _MATCHERS[key]


_FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<struct<item:string,found:int,windows:int>>"


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _scan(key: str, items, width: int, text_at: int, follows: bool):
    """Adds the three columns of ``_FOUND``; where it ``follows`` another scan they are there and are added to."""
    kind = pa.struct([("first", pa.int32()), ("end", pa.int32())])
    of_item = pa.struct([("item", pa.string()), ("found", pa.int32()), ("windows", pa.int32())])

    def run(batches):
        matcher = _matcher(key, items, width)
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            own = batch.num_columns - (3 if follows else 0)
            for k in range(0, len(batch), 512):
                part, n, spans, found = batch.slice(k, 512), [], [], []
                before = zip(part.column(own + 1).to_pylist(), part.column(own + 2).to_pylist()) if follows else itertools.repeat(([], []))
                for text, (old_spans, old_items) in zip(texts.slice(k, 512), before):
                    a, b, c = matcher.scan(text.as_py() or b"")
                    n.append(a)
                    spans.append([{"first": x, "end": y} for x, y in _joined([*b, *((s["first"], s["end"]) for s in old_spans)])])
                    found.append(sorted([{"item": i, "found": len(ps), "windows": len(matcher.total[i])} for i, ps in c.items()] + old_items, key=lambda x: x["item"]))
                names = [f"c{i}" for i in range(own)]
                yield pa.RecordBatch.from_arrays([*part.columns[:own], pa.array(n, pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(found, pa.list_(of_item))], names=[*names, "n_words", "spans", "items"])

    return textbytes.lean(run)


def find_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, hit word ``spans`` and ``items`` (item, windows found, windows in all)."""
    spark, columns = docs.sparkSession, docs.columns
    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    named = scratch.keep(named, "items")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-int(size) // block_bytes) or 1
    # within, columns go by their place, so that no name of the table's own can clash
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for k in range(parts):
        block = named if parts == 1 else named.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        held = sorted((r.item, bytes(r.text)) for r in block.toLocalIterator())
        key = hashlib.sha256(repr((width, held)).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(held)
        scanned = rows.mapInArrow(_scan(key, sent, width, columns.index("text"), k > 0), f"{fields}, {_FOUND}")
        rows = scanned if k + 1 == parts else scratch.keep(scanned, "found")
    return rows.toDF(*columns, "n_words", "spans", "items")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, least_items: int = 2, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    found = find_items(docs.select("doc_id", "text"), items, width, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x["item"])), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """``docs`` without those that hold a window of an item."""
    inner = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    clean = find_items(inner, items, width, **options).where(F.size("items") == 0)
    return clean.select(inner.columns).toDF(*docs.columns)
