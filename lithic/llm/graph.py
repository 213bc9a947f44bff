"""Connected components of an undirected graph by alternating large and small stars; everything stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """`v`, `root` (smallest vertex of its component) for each vertex of edges (`a`, `b`, longs). Vertices without edges are left out."""
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct(), "edges")
    before = None
    while True:
        # Large star: each neighbour above u is linked to the smallest of u and its neighbours.
        both = state.unionAll(state.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w"))
        # Small star: u and its neighbours below are linked to the smallest of them.
        large = cut(large.where("u <> w").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).unionAll(least.select("u", F.col("m").alias("w")))
        state = cut(small.where("u <> w").distinct(), "edges")
        now = state.agg(F.count(F.lit(1)), F.sum(F.hash("u", "w").cast("long"))).first()
        if tuple(now) == before:
            return state.select(F.col("u").alias("v"), F.col("w").alias("root")).unionAll(state.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
        before = tuple(now)
