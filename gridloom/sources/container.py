"""A container of coded tensors: header, directory, blobs. Read by directory, or laid out as a table of blobs in which filters reach the scan."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import packing, rans
from gridloom.shipping import ship

# The format's magic, version, header and directory fields.
MAGIC, VERSION, SCALE_BITS = b"K9Q1", 1, 12
HEADER = struct.Struct("<4sHHIIQQ")
FIELDS = struct.Struct("<BBBBBBIIIIQ")
SCHEMA = "name string, shape array<long>, k int, grp int, mode string, tbl int, dig int, sca int, plen int, off long"


def write(tensors: list[dict]) -> bytes:
    """Tensors of name, shape, k, group, mode, digits, scales and perhaps perm, as one container."""
    blobs, names = [], []
    for t in tensors:
        table = rans.Table.of(t["digits"], t["k"], 1 << SCALE_BITS)
        perm = t.get("perm")
        blobs.append((np.array(table.freqs, "<u2").tobytes(), rans.encode(t["digits"], table), packing.encode_scales(t["scales"], t["mode"]), b"" if perm is None else np.asarray(perm, "<u4").tobytes()))
        names.append(t["name"].encode())
    size = sum(2 + len(n) + 1 + 4 * len(t["shape"]) + FIELDS.size for n, t in zip(names, tensors))
    at = HEADER.size + size
    out = io.BytesIO()
    out.write(HEADER.pack(MAGIC, VERSION, 0, len(tensors), SCALE_BITS, HEADER.size, at))
    for name, t, parts in zip(names, tensors, blobs):
        out.write(struct.pack(f"<H{len(name)}sB{len(t['shape'])}I", len(name), name, len(t["shape"]), *t["shape"]))
        out.write(FIELDS.pack(t["k"], t["group"], 0, packing.SCALE_MODES[t["mode"]], 0, int(bool(parts[3])), *map(len, parts), at))
        at += sum(map(len, parts))
    for parts in blobs:
        out.write(b"".join(parts))
    return out.getvalue()


def directory(data: bytes) -> list[dict]:
    """The records of a container; another magic or version is an error."""
    magic, version, _, n, _, at, _ = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"not a container of version {VERSION}")
    modes, out = {v: k for k, v in packing.SCALE_MODES.items()}, []
    for _ in range(n):
        (size,) = struct.unpack_from("<H", data, at)
        name, rank = data[at + 2 : at + 2 + size].decode(), data[at + 2 + size]
        at += 3 + size
        shape = list(struct.unpack_from(f"<{rank}I", data, at))
        at += 4 * rank
        k, group, _, mode, _, _, tbl, dig, sca, plen, off = FIELDS.unpack_from(data, at)
        at += FIELDS.size
        out.append({"name": name, "shape": shape, "k": k, "grp": group, "mode": modes[mode], "tbl": tbl, "dig": dig, "sca": sca, "plen": plen, "off": off})
    return out


def tensor(data: bytes, record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Digits, scales and permutation of a record."""
    at, n = record["off"], int(np.prod(record["shape"]))
    freqs = np.frombuffer(data, "<u2", record["tbl"] // 2, at)
    at += record["tbl"]
    digits = rans.decode(data[at : at + record["dig"]], n, rans.Table(tuple(int(f) for f in freqs), 1 << SCALE_BITS))
    at += record["dig"]
    scales = packing.decode_scales(data[at : at + record["sca"]], record["mode"], n // record["grp"])
    at += record["sca"]
    return digits, scales, np.frombuffer(data, "<u4", record["plen"] // 4, at) if record["plen"] else None


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of containers, by Spark's own reader; for files of up to 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def directories(files: DataFrame) -> DataFrame:
    """(path, directory record) of ``files(path, content)``."""
    ship(files.sparkSession)

    def run(frames):
        for f in frames:
            yield pd.DataFrame([{"path": p, **r} for p, c in zip(f["path"], f["content"]) for r in directory(bytes(c))], columns=["path", *[c.split()[0] for c in SCHEMA.split(", ")]])

    return files.select("path", "content").mapInPandas(run, f"path string, {SCHEMA}")


def blobs(files: DataFrame) -> DataFrame:
    """Directory records with each tensor's ``blob``, a row a tensor: a table to be written once as Parquet.

    From there a filter on ``name`` and the choice of columns reach the scan, so one tensor is
    read without the others; :func:`decoded` takes such rows.
    """
    ship(files.sparkSession)

    def run(frames):
        for f in frames:
            for p, c in zip(f["path"], f["content"]):
                data = bytes(c)
                for r in directory(data):  # one tensor at a time
                    size = r["tbl"] + r["dig"] + r["sca"] + r["plen"]
                    yield pd.DataFrame([{"path": p, **r, "blob": data[r["off"] : r["off"] + size]}])

    return files.select("path", "content").mapInPandas(run, f"path string, {SCHEMA}, blob binary")


def decoded(rows: DataFrame) -> DataFrame:
    """(path, name, k, digits, scales, perm) of rows of :func:`blobs`."""
    ship(rows.sparkSession)
    fields = ["path", "name", "shape", "k", "grp", "mode", "tbl", "dig", "sca", "plen", "blob"]

    def run(frames):
        for f in frames:
            for r in f.to_dict("records"):
                d, s, perm = tensor(bytes(r["blob"]), {**r, "off": 0})
                yield pd.DataFrame({"path": [r["path"]], "name": [r["name"]], "k": [r["k"]], "digits": [d.astype(np.int32)], "scales": [s], "perm": [None if perm is None else perm.astype(np.int64)]})

    return rows.select(*fields).mapInPandas(run, "path string, name string, k int, digits array<int>, scales array<float>, perm array<long>")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return directories(files_at(spark, path))


def read_tensors(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(path, name, k, digits, scales, perm), decoding only the named tensors."""
    rows = blobs(files_at(spark, path))
    return decoded(rows if names is None else rows.where(F.col("name").isin(*names)))


def summary(records: DataFrame) -> DataFrame:
    """(path, tensors, k_modal, bits): how many tensors, their commonest k, and coded bits a parameter."""
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    r = records.withColumn("n", n).groupBy("path", "k").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.expr("cast(tbl as long) + dig + sca + plen")).alias("b"))
    return r.groupBy("path").agg(F.sum("c").alias("tensors"), F.max_by("k", F.struct("c", "k")).alias("k_modal"), (8.0 * F.sum("b") / F.sum("n")).alias("bits"))
