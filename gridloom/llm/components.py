"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima (combined before the shuffle) and joins back
on the grouping key, so a vertex with very many links is split by the adaptive
skew join and nothing is gathered in one task or on the driver. The rounds are
written to the shared folder; their number is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import scratch


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(v, component) for every vertex of ``edges(a, b)``; component is the smallest vertex reachable.

    Null ends, loops and repeated edges are ignored. No edges: no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now = scratch.keep(now, "edges")
    for _ in range(rounds):
        # large star: every larger neighbour of v is tied to the least of v and its neighbours
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: the smaller neighbours of v, and v, are tied to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = small.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        after = scratch.keep(after, "edges")
        same = _digest(now) == _digest(after)
        scratch.drop(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select("v", F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("v"), F.col("u").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
