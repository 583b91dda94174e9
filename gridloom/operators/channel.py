"""Deterministic and seeded degradation of stored weights and of what reads them, in a fixed order of effects.

Random numbers come from hashes of (seed, subject, tensor, row, column, effect), so they depend neither
on partitions nor on an order, and are shared by all subjects where none is named. Uniform ones stay in
the JVM; normal ones are made in Python, whose logarithm and cosine are the C library's, to the last bit.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gridloom.functions.grid import let
from gridloom.operators import layout
from gridloom.shipping import ship


@dataclass(frozen=True)
class Channel:
    """Noise of writing and reading and drift (relative), share of stuck cells, write levels, dead zone, loss along a row.

    ``subject`` gives each subject noise of its own; '' pairs them.
    """

    write_noise: float = 0.0
    read_noise: float = 0.0
    drift: float = 0.0
    stuck: float = 0.0
    levels: int = 0
    dead_zone: float = 0.0
    ramp: float = 0.0
    seed: int = 0
    subject: str = ""


def uniform(key: Column, part: int = 0) -> Column:
    """A number between 0 and 1 from the key's MD5: its first or second 32 bits."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 8 * part + 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)


def with_normals(rows: DataFrame, **keys: Column) -> DataFrame:
    """``rows`` and, for each name, standard normal numbers from the MD5 of each of its array of keys (Box and Muller's way).

    A converter that is scaled by the largest of noisy values has that value half way between
    two steps, so the last bit decides: the JVM's logarithm and cosine differ there from the
    C library's.
    """
    ship(rows.sparkSession)
    rows, made = rows.withColumns(keys), set(keys)
    schema = StructType([StructField(f.name, ArrayType(DoubleType()) if f.name in made else f.dataType) for f in rows.schema])

    def one(key: str) -> float:
        a, b = struct.unpack_from(">II", hashlib.md5(key.encode()).digest())
        return math.sqrt(-2.0 * math.log((a + 0.5) / 4294967296.0)) * math.cos(6.283185307179586 * ((b + 0.5) / 4294967296.0))

    def run(batches):
        for batch in batches:
            columns = [pa.array([None if k is None else [one(x) for x in k] for k in c.to_pylist()], pa.list_(pa.float64())) if name in made else c for name, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, schema)


def _key(p: Channel, effect: str, *parts) -> Column:
    return F.concat_ws(":", F.lit(str(p.seed)), F.lit(p.subject), *[x.cast("string") for x in parts], F.lit(effect))


def _noisy(w: DataFrame, p: Channel) -> DataFrame:
    """``w(tensor, row, v, m)`` with noise, drift and stuck cells in ``v``."""
    key = lambda effect, i: _key(p, effect, F.col("tensor"), F.col("row"), i)
    of_row = lambda effect: F.transform("v", lambda _, i: key(effect, i))
    sizes = {"write": p.write_noise, "read": p.read_noise, "drift": p.drift}
    names = {effect: f"_{effect}" for effect, size in sizes.items() if size}
    m = F.col("m")

    def one(c: Column, i: Column) -> Column:
        x = c["v"]
        if p.write_noise:
            x = x + p.write_noise * m * c["_write"]
        if p.read_noise:
            x = x + p.read_noise * m * c["_read"]
        if p.drift:
            x = x * (1.0 + p.drift * c["_drift"])
        return F.when(uniform(key("stuck", i)) < p.stuck, F.when(uniform(key("stuck", i), 1) < 0.5, m).otherwise(-m)).otherwise(x) if p.stuck else x

    made = with_normals(w, **{name: of_row(effect) for effect, name in names.items()}) if names else w
    return made.withColumn("v", F.transform(F.arrays_zip("v", *names.values()), one)).drop(*names.values())


def _exact(v: str, m: Column, p: Channel) -> Column:
    """Levels, dead zone, rails and ramp: what needs no random numbers, as array expressions."""

    def one(x: Column, i: Column) -> Column:
        if p.levels > 1:
            step = 2.0 * m / (p.levels - 1)
            x = F.when(m == 0, x).otherwise(F.rint(x / step) * step)
        if p.dead_zone > 0:
            x = F.when(F.abs(x) < p.dead_zone * m, 0.0).otherwise(x)
        x = F.least(F.greatest(x, -m), m)
        return x * (1.0 + F.lit(-p.ramp) * i / F.greatest(F.size(v) - 1, F.lit(1))) if p.ramp > 0 else x

    return F.transform(v, one)


def _degraded(w: DataFrame, p: Channel) -> DataFrame:
    if p.write_noise or p.read_noise or p.drift or p.stuck:
        w = _noisy(w, p)
    return w.withColumn("v", _exact("v", F.col("m"), p)).drop("m")


def degrade(wide: DataFrame, p: Channel) -> DataFrame:
    """(tensor, row, v), each row scaled by its own largest weight, without a shuffle."""
    return _degraded(wide.withColumn("m", layout.absmax("v")), p)


def degrade_by_tensor(wide: DataFrame, p: Channel) -> DataFrame:
    """The same, scaled by each tensor's largest weight."""
    top = wide.groupBy("tensor").agg(F.max(layout.absmax("v")).alias("m"))
    return _degraded(wide.join(top, "tensor"), p)


def _top(v: Column) -> Column:
    return F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(1e-8))


def _converted(v: Column, bits: int) -> Column:
    """A row on the 2^bits - 1 steps between its largest magnitudes."""
    return let(v, lambda g: let(2.0 * _top(g) / float(2**bits - 1), lambda step: F.transform(g, lambda x: F.rint(x / step) * step)))


def read_in(wide: DataFrame, p: Channel, gamma: float, bits: int) -> DataFrame:
    """What a layer gets: each column times its own gain (spread ``gamma``, within four spreads), through a converter."""
    if not gamma:
        return wide.withColumn("v", _converted(F.col("v"), bits))
    made = with_normals(wide, _gain=F.transform("v", lambda _, i: _key(p, "gain", F.col("tensor"), i)))
    gained = F.zip_with("v", "_gain", lambda x, n: x * (1.0 + gamma * F.least(F.greatest(n, F.lit(-4.0)), F.lit(4.0))))
    return made.withColumn("v", _converted(gained, bits)).drop("_gain")


def read_out(wide: DataFrame, p: Channel, bits: int) -> DataFrame:
    """What a layer gives: noise relative to each row's largest output, through a converter."""
    if not p.read_noise:
        return wide.withColumn("v", _converted(F.col("v"), bits))
    made = with_normals(wide, _out=F.transform("v", lambda _, i: _key(p, "out", F.col("tensor"), F.col("row"), i)))
    noisy = let(_top(F.col("v")), lambda m: F.zip_with("v", "_out", lambda x, n: x + p.read_noise * m * n))
    return made.withColumn("v", _converted(noisy, bits)).drop("_out")
