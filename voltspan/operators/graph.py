"""Graph operators on edge tables (a, b): components, statistics, bridges and bounded search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators import tours
from voltspan.operators.tables import settle

PARTS = 64


def components(edges: DataFrame, trace: list | None = None) -> DataFrame:
    """node, component (the least node reachable), from the roots of a spanning forest: rounds grow with the logarithm of the
    network, however its nodes are numbered. A node with nothing but a loop is a component of its own."""
    rows = settle(edges.select("a", "b"), "edges")
    _, roots = tours.forest(rows.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), trace)
    # Nearly all nodes may have one root; it's joined back by root and a part of the node.
    part = F.pmod(F.hash("node"), F.lit(PARTS))
    named = roots.groupBy("root", part.alias("part")).agg(F.min("node").alias("component"))
    least = named.groupBy("root").agg(F.min("component").alias("component"))
    least = named.select("root", "part").join(least, "root")
    labels = roots.withColumn("part", part).join(least, ["root", "part"]).select("node", "component")
    loops = rows.where("a = b").select(F.col("a").alias("node")).distinct()
    alone = loops.join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return settle(labels.unionByName(alone), "labels")


def bridges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """component, a, b of edges whose loss splits their component, as labels (node, component) names it."""
    return tours.bridges(edges).select("a", "b").join(labels.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b")


def within(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node, hops: the fewest edges from start (node) to each node within the bound."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = start.select("node", F.lit(0).cast("long").alias("hops")).distinct()
    front = seen
    for k in range(1, hops + 1):
        reached = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        front = settle(reached.join(seen, "node", "left_anti").select("node", F.lit(k).cast("long").alias("hops")), "front")
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, start: DataFrame, stop: Column, hops: int) -> DataFrame:
    """src, path, hops: the shortest way from each start (node) to a tip for which stop holds, in at most so many edges.

    Of equally short ways the one whose text is least. Each node that a source has met is met once, so a round holds at most as
    many rows as there are nodes for each source.
    """
    both = edges.select(F.col("a").alias("tip"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("tip"), F.col("a").alias("next"))).distinct()
    front = start.select(F.col("node").alias("src"), F.col("node").alias("tip"), F.col("node").cast("string").alias("path"), F.lit(0).cast("long").alias("hops"))
    seen, found = front.select("src", "tip"), None
    for k in range(hops + 1):
        hit = front.where(stop).groupBy("src").agg(F.min("path").alias("path"), F.first("hops").alias("hops"))
        found = hit if found is None else found.unionByName(hit)
        if k == hops:
            break
        going = front.join(hit.select("src"), "src", "left_anti")
        step = going.join(both, "tip").select("src", F.col("next").alias("tip"), F.concat_ws("-", "path", "next").alias("path"))
        step = step.join(seen, ["src", "tip"], "left_anti").groupBy("src", "tip").agg(F.min("path").alias("path"))
        front = settle(step.withColumn("hops", F.lit(k + 1).cast("long")), "paths")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("src", "tip"))
    return found


def bridge_flows(edges: DataFrame, injections: DataFrame) -> DataFrame:
    """a, b, flow of edges that are bridges: what the nodes on a's side inject; injections (node, p). Edges on a cycle are left out."""
    return tours.sides(edges, injections, ["p"]).select("a", "b", F.col("a_p").alias("flow"))
