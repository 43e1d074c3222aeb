"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, shuffled

# Edges up to which the planner may broadcast them.
FEW = 200_000


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, component (its smallest node), for every node of an edge table (a, b); self-loops count as nodes.

    Large-star and small-star steps alternate until the edges are stars around the smallest nodes, in about
    log n rounds. Each is a map-side combined minimum and a join with one row per node on the other side, so
    no neighbourhood is ever gathered; a hub's rows can be split by the adaptive planner.
    """
    loops = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, before = work.stash(state, "edges"), None
    while True:
        sums = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(sums) or not sums[0]:
            break
        before = tuple(sums)
        side = shuffled if sums[0] > FEW else lambda df: df
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = work.stash(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        work.drop(state)
        state = new
    return loops.join(shuffled(state.select(F.col("u").alias("node"), F.col("v").alias("component"))), "node", "left").withColumn("component", F.coalesce("component", "node"))
