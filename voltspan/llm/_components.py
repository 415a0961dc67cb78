"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._io import materialise, release
from voltspan.llm._skew import join_hot


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node links its larger neighbours to the least of its neighbours and itself. Small: its smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = join_hot(both, least, "a", "b")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a, b) -> node, component: the least node reachable. Nodes without an edge have no row."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    for _ in range(most):
        large = materialise(_star(edges, True), "components")
        release(edges)
        edges = materialise(_star(large, False), "components")
        release(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
