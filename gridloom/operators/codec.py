"""Entropy coding of digit streams: tensors and their lanes are the unit of parallel work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import rans
from gridloom.operators import layout
from gridloom.shipping import ship

TOTAL = 4096


def frequencies(digits: DataFrame, k: int) -> DataFrame:
    """(tensor, freqs): normalised tables from counts that are summed before the shuffle; a row a tensor."""
    h = digits.select("tensor", F.explode("d").alias("s")).groupBy("tensor", "s").agg(F.count("*").alias("n"))
    packed = h.groupBy("tensor").agg(F.collect_list(F.struct("s", "n")).alias("h"))

    @F.pandas_udf("array<int>")
    def table(hs: pd.Series) -> pd.Series:
        def one(h):
            counts = np.zeros(k, dtype=np.int64)
            for x in h:
                counts[x["s"]] = x["n"]
            return rans.normalized(counts, TOTAL).astype(np.int32)

        return hs.map(one)

    return packed.select("tensor", table("h").alias("freqs"))


def _alike(freqs, sizes):
    """Positions of lanes that share a table and a length: they are coded abreast."""
    groups: dict[tuple, list[int]] = {}
    for i, (f, n) in enumerate(zip(freqs, sizes)):
        groups.setdefault((tuple(int(x) for x in f), int(n)), []).append(i)
    return groups.items()


def encode_lanes(digits: DataFrame, k: int, rows_in_lane: int = 64) -> DataFrame:
    """(tensor, lane, rows, n, freqs, stream): lanes of consecutive rows, each a stream of its own, one table a tensor."""
    ship(digits.sparkSession)
    numbers = layout.pages(digits.select("tensor", "row").distinct(), rows_in_lane).select("tensor", "row", F.col("page").alias("lane"))
    lanes = digits.join(numbers, ["tensor", "row"]).groupBy("tensor", "lane").agg(F.array_sort(F.collect_list(F.struct("row", "grp", "d"))).alias("rs"))
    lanes = lanes.select("tensor", "lane", F.size("rs").alias("rows"), F.flatten(F.transform("rs", lambda x: x["d"])).alias("d")).join(frequencies(digits, k), "tensor")

    def run(frames):
        for f in frames:
            streams = [b""] * len(f)
            for (freqs, _), at in _alike(f["freqs"], f["d"].map(len)):
                for i, s in zip(at, rans.encode_many(np.array([f["d"].iloc[i] for i in at]), rans.Table(freqs, TOTAL))):
                    streams[i] = s
            yield pd.DataFrame({"tensor": f["tensor"], "lane": f["lane"], "rows": f["rows"], "n": f["d"].map(len), "freqs": f["freqs"], "stream": streams})

    return lanes.mapInPandas(run, "tensor int, lane long, rows int, n int, freqs array<int>, stream binary")


def decode_lanes(lanes: DataFrame) -> DataFrame:
    """(tensor, lane, d)."""
    ship(lanes.sparkSession)

    def run(frames):
        for f in frames:
            d = [None] * len(f)
            for (freqs, n), at in _alike(f["freqs"], f["n"]):
                for i, row in zip(at, rans.decode_many([f["stream"].iloc[i] for i in at], n, rans.Table(freqs, TOTAL))):
                    d[i] = row
            yield pd.DataFrame({"tensor": f["tensor"], "lane": f["lane"], "d": d})

    return lanes.select("tensor", "lane", "n", "freqs", "stream").mapInPandas(run, "tensor int, lane long, d array<int>")
