"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vispark.llm.common import release, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: the greater, small: the smaller ones) to its smallest neighbour."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """u, v -> u, v: each node of the edges but a component's smallest, and that smallest node.

    Every round is written to the shared folder; a round that changes nothing ends the loop.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        last, now = now, staged(_stars(_stars(now, True), False), "edges")
        release(last)
        after = mark(now)
        if after == before:
            return now
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now
