"""Distributed union-find on edge tables (large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Each linked vertex with the smallest vertex it can reach.

    ``edges`` has two columns of one orderable type, in either direction, repeated or
    not; loops count as nothing. Returns (v, component) for every vertex that is not
    the smallest of its component. Every round is one aggregation and one join on the
    vertex, whose skew (a hub) the adaptive join splits, and is saved in the shared
    folder. No vertex or edge reaches the driver.
    """
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cur = scratch.save(e)
    for _ in range(max_rounds):
        ends = cur.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionAll(cur.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return cur.select(F.col("u").alias("v"), F.col("v").alias("component"))  # only stars are left
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                )
            ).alias("e")
        )
        nxt = scratch.save(small.select("e.u", "e.v").where("u <> v").distinct())
        scratch.drop(cur)
        cur = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
