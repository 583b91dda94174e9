"""Directories of coded tensors as bytes: what a model file's key holds beside the blobs, and arrays files.

A directory is a little-endian version and count, then a record a tensor. Version 2
records have a lane count, version 1 records (without the version field) have one
lane. The page table lists the tensors that have several lanes.
"""

from __future__ import annotations

import io
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys under which a directory may stand, best first, and their versions.
KEYS = (("ninths.directory2", 2), ("ninths.directory", 1), ("k9.directory", 1))
RECORD = "name string, rows long, cols long, k int, group int, mode int, perm int, lanes int, tbl long, dig long, sca long, plen long"


def little(x: Column, size: int) -> Column:
    """``size`` bytes of a number, least first, as hexadecimal text."""
    wide = F.lpad(F.hex(x.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(wide, 2 * (size - k) - 1, 2) for k in range(size)])


def _name(name: Column) -> Column:
    return F.concat(little(F.octet_length(name), 2), F.hex(name.cast("binary")))


def _laid(tensors: DataFrame, record: Column, order: str, head: list[Column]) -> DataFrame:
    """One row: the records in order behind a head that may use their count ``n``. A directory has a row a tensor."""
    rows = tensors.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r")))), lambda x: x["r"]).alias("rs"))
    return rows.withColumn("n", F.size("rs")).select(F.unhex(F.concat(*head, F.array_join("rs", ""))).alias("bytes"))


def build_directory(tensors: DataFrame, order: str, version: int = 2) -> DataFrame:
    """(bytes): the directory of ``tensors`` (columns of ``RECORD``), in the order of a column."""
    lanes = [little(F.col("lanes"), 1)] if version == 2 else []
    record = F.concat(
        _name(F.col("name")), little(F.lit(2), 1), little(F.col("rows"), 4), little(F.col("cols"), 4), *[little(F.col(c), 1) for c in ("k", "group", "mode", "perm")],
        *lanes, *[little(F.col(c), 4) for c in ("tbl", "dig", "sca", "plen")],
    )
    return _laid(tensors, record, order, ([little(F.lit(2), 2)] if version == 2 else []) + [little(F.col("n"), 2)])


def build_pages(tensors: DataFrame, order: str) -> DataFrame:
    """(bytes): the page table of those ``tensors(name, lanes, page_rows)`` that have several lanes."""
    record = F.concat(_name(F.col("name")), little(F.col("lanes"), 1), little(F.col("page_rows"), 4))
    return _laid(tensors.where("lanes > 1"), record, order, [little(F.lit(1), 2), little(F.col("n"), 2)])


def read_records(data: bytes, version: int) -> list[tuple]:
    """The records of a directory, as rows of ``RECORD``; anything left over is an error."""
    at = 4 if version == 2 else 2
    (count,) = struct.unpack_from("<H", data, at - 2)
    if version == 2 and struct.unpack_from("<H", data)[0] != 2:
        raise ValueError("not a directory of version 2")
    rest = struct.Struct("<5B4I" if version == 2 else "<4B4I")
    out = []
    for _ in range(count):
        (size,) = struct.unpack_from("<H", data, at)
        name = data[at + 2 : at + 2 + size].decode()
        rank, rows, cols = struct.unpack_from("<BII", data, at + 2 + size)
        if rank != 2:
            raise ValueError(f"{name} has rank {rank}")
        at += 11 + size
        k, group, mode, perm, *more = rest.unpack_from(data, at)
        at += rest.size
        out.append((name, rows, cols, k, group, mode, perm, *(more if version == 2 else (1, *more))))
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes after the last record")
    return out


def read_directories(files: DataFrame) -> DataFrame:
    """(file, position) and ``RECORD`` of ``files(file, keys)``, ``keys`` a map of byte values; the first of ``KEYS`` that is there counts, a file without one has no records."""
    found = F.coalesce(*[F.when(F.map_contains_key("keys", F.lit(k)), F.struct(F.lit(v).alias("v"), F.try_element_at("keys", F.lit(k)).alias("b"))) for k, v in KEYS])

    def run(frames):
        for f in frames:
            rows = [(name, i, *r) for name, v, b in zip(f["file"], f["v"], f["b"]) for i, r in enumerate(read_records(bytes(b), v))]
            yield pd.DataFrame(rows, columns=["file", "position", *[c.split()[0] for c in RECORD.split(", ")]])

    own = files.select("file", found.alias("x")).where("x is not null").select("file", "x.v", "x.b")
    return own.mapInPandas(run, f"file string, position int, {RECORD}")


def read_pages(files: DataFrame) -> DataFrame:
    """(file, name, lanes, page_rows) of ``files(file, bytes)``."""

    def run(frames):
        for f in frames:
            rows = []
            for file, data in zip(f["file"], f["bytes"]):
                data, at = bytes(data), 4
                for _ in range(struct.unpack_from("<H", data, 2)[0]):
                    (size,) = struct.unpack_from("<H", data, at)
                    rows.append((file, data[at + 2 : at + 2 + size].decode(), *struct.unpack_from("<BI", data, at + 2 + size)))
                    at += 7 + size
            yield pd.DataFrame(rows, columns=["file", "name", "lanes", "page_rows"])

    return files.select("file", "bytes").mapInPandas(run, "file string, name string, lanes int, page_rows long")


def write_arrays(rows: DataFrame, file: str, name: str, values: str) -> DataFrame:
    """(file, bytes): one arrays file (npz) for each ``file``, of its one-dimensional arrays; it is made in one task, as one artefact."""

    def run(key, frame):
        import numpy as np

        out = io.BytesIO()
        np.savez(out, **{n: np.asarray(v) for n, v in sorted(zip(frame[name], frame[values]), key=lambda x: x[0])})
        return pd.DataFrame({"file": [key[0]], "bytes": [out.getvalue()]})

    return rows.select(F.col(file).cast("string").alias(file), name, values).groupBy(file).applyInPandas(run, "file string, bytes binary")


def read_arrays(files: DataFrame, pattern: str) -> DataFrame:
    """(file, name, key, values) of the arrays whose name matches; ``key`` is the pattern's first group."""

    def run(frames):
        import re

        import numpy as np

        match = re.compile(pattern).fullmatch
        for f in frames:
            for file, data in zip(f["file"], f["bytes"]):
                with np.load(io.BytesIO(bytes(data))) as z:
                    for n in z.files:  # one array at a time
                        got = match(n)
                        if got:
                            yield pd.DataFrame({"file": [file], "name": [n], "key": [got[1]], "values": [z[n].astype(float).ravel()]})

    return files.select("file", "bytes").mapInPandas(run, "file string, name string, key string, values array<double>")
