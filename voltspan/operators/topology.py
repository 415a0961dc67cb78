"""Bus-branch topology from terminals and switches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators import graph

#: Voltages of two contracted terminals differ by at most this part of the greater one.
APART = 0.02


def closed_couplers(terminals: DataFrame, couplers: DataFrame) -> DataFrame:
    """Edges (a, b) of couplers (a, b, closed, in_service) that join terminals (id, kv, in_service) to one node."""
    good = terminals.where(F.col("in_service") & (F.col("kv") > 0))
    end = lambda c: good.select(F.col("id").alias(c), F.col("kv").alias(f"kv_{c}"))
    edges = couplers.where(F.col("closed") & F.col("in_service")).join(end("a"), "a").join(end("b"), "b")
    return edges.where(F.abs(F.col("kv_a") - F.col("kv_b")) <= APART * F.greatest("kv_a", "kv_b")).select("a", "b")


def contracted(terminals: DataFrame, couplers: DataFrame) -> DataFrame:
    """id, node: the least terminal that closed couplers join it with; terminals out of service have none."""
    labels = graph.components(closed_couplers(terminals, couplers))
    good = terminals.where(F.col("in_service") & (F.col("kv") > 0)).select("id")
    return good.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("node"))


def connected(equipment: DataFrame, switches: DataFrame) -> DataFrame:
    """equipment (id, terminal) whose switches (id, closed) don't block it; an open switch never splits a node."""
    return equipment.join(switches.where("not closed").select("id"), "id", "left_anti")


def buses(nodes: DataFrame, equipment: DataFrame) -> DataFrame:
    """node, n_terminals, n_equipment of the nodes that hold equipment."""
    held = equipment.join(nodes, F.col("terminal") == nodes["id"]).groupBy("node").agg(F.count("*").cast("long").alias("n_equipment"))
    return nodes.groupBy("node").agg(F.count("*").cast("long").alias("n_terminals")).join(held, "node")


def islands(bus: DataFrame, branches: DataFrame, grids: DataFrame) -> DataFrame:
    """component, n_buses, kind of buses (node), branches (a, b) and the nodes of grids: one component alone is NORMAL, else
    those with a grid are TRUE_ISLAND and the others UNSUPPLIED."""
    labels = graph.components(branches)
    of = bus.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    fed = of.join(grids.select("node").distinct().withColumn("grid", F.lit(1)), "node", "left")
    per = fed.groupBy("component").agg(F.count("*").cast("long").alias("n_buses"), F.count("grid").alias("_grids"))
    total = per.agg(F.count("*").alias("_total"))
    kind = F.when(F.col("_total") == 1, "NORMAL").when(F.col("_grids") > 0, "TRUE_ISLAND").otherwise("UNSUPPLIED")
    return per.join(total).select("component", "n_buses", kind.alias("kind"))


def folded(injections: DataFrame, levels: DataFrame, branches: DataFrame, least_kv: float) -> DataFrame:
    """Voltage-level reduction: node, p of the nodes (id, kv) from least_kv on.

    The injections (id, p) of a low island go to the one high node that it touches; with none or several they are left out.
    """
    high = levels.where(F.col("kv") >= least_kv).select("id")
    low = levels.where(F.col("kv") < least_kv).select("id")
    inner = branches.join(low.select(F.col("id").alias("a")), "a", "left_semi").join(low.select(F.col("id").alias("b")), "b", "left_semi")
    labels = graph.components(inner).select(F.col("node").alias("id"), "component")
    of = low.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    both = branches.select("a", "b").unionByName(branches.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edge = both.join(of.select(F.col("id").alias("a"), "component"), "a").join(high.select(F.col("id").alias("b")), "b", "left_semi")
    one = edge.groupBy("component").agg(F.count_distinct("b").alias("_n"), F.min("b").alias("node")).where("_n = 1")
    moved = injections.join(of, "id").join(one, "component").select("node", "p")
    own = injections.join(high, "id", "left_semi").select(F.col("id").alias("node"), "p")
    return own.unionByName(moved).groupBy("node").agg(F.sum("p").alias("p"))
