"""Parents of nodes: chains, the nearest ancestor of a kind, and references that must be unambiguous."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators.tables import settle


def ancestors(nodes: DataFrame, tree: DataFrame, most: int = 24) -> DataFrame:
    """nodes and tree (id, parent) -> id, ancestor, depth: each node itself (depth 0) and its parents up to a depth.

    A chain ends where a parent is unknown, stands twice in the tree, or was met before. One join a level, each on tables of its
    own, so that no level is computed again for the next; a chain that has ended takes no part in the next.
    """
    once = tree.groupBy(F.col("id").alias("_up")).agg(F.count("*").alias("_n"), F.first("parent").alias("_above")).where("_n = 1").drop("_n")
    # Merged rather than broadcast: the tree would go through the driver once a level.
    once = settle(once, "tree").hint("merge")
    at = nodes.select("id", F.col("id").alias("ancestor"), "parent", F.lit(0).cast("long").alias("depth"), F.array("id").alias("_seen"))
    levels = [at.select("id", "ancestor", "depth")]
    for _ in range(most):
        open_ends = at.where(F.col("parent").isNotNull() & ~F.array_contains("_seen", F.col("parent")))
        step = open_ends.join(once, F.col("parent") == F.col("_up")).select("id", F.col("_up").alias("ancestor"), F.col("_above").alias("parent"), (F.col("depth") + 1).alias("depth"), F.array_append("_seen", F.col("_up")).alias("_seen"))
        at = settle(step, "ancestors")
        if at.isEmpty():
            break
        levels.append(at.select("id", "ancestor", "depth"))
    return reduce(DataFrame.unionByName, levels)


def nearest(chains: DataFrame, wanted: DataFrame) -> DataFrame:
    """chains of ancestors and wanted (ancestor) -> id, ancestor: the nearest wanted one of each node that has any."""
    return chains.join(wanted.select("ancestor").distinct(), "ancestor", "left_semi").groupBy("id").agg(F.min_by("ancestor", "depth").alias("ancestor"))


def unambiguous_class(classes: dict[str, DataFrame]) -> DataFrame:
    """id, class of the ids that just one of the classes has."""
    every = reduce(DataFrame.unionByName, (df.select("id", F.lit(name).alias("class")) for name, df in classes.items()))
    kinds = every.groupBy("id").agg(F.count_distinct("class").alias("_n"), F.first("class").alias("class"))
    return kinds.where("_n = 1").drop("_n")
