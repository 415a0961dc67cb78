"""Ways to energize lines: from each end over couplers to a terminal in service, with what must be closed and what stands in the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators.stations import searches
from voltspan.operators.tables import settle


def steps(lines: DataFrame, terminals: DataFrame, couplers: DataFrame, most: int | None = None) -> DataFrame:
    """line, side, start, step, coupler, terminal, closes, restores: the ways of plans, a row a terminal.

    lines (id, a, b), terminals (id, in_service), couplers (id, a, b, closed, in_service). A search begins once at each terminal that
    is any line's end, not once a line. The nearest terminal in service is met, of several the least; of equally short ways the
    one whose couplers are least, told from there back. A way may be of any length, or of at most so many couplers."""
    ends = lines.select(F.col("id").alias("line"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("start")), F.struct(F.lit("b").alias("side"), F.col("b").alias("start")))).alias("e")).select("line", "e.side", "e.start").where("start is not null")
    one = F.lit(0).alias("grp")
    ways = searches(
        couplers.where("in_service").select(one, F.col("a").alias("x"), F.col("b").alias("y"), F.col("id").cast("string").alias("via")),
        ends.select(one, F.col("start").alias("label"), F.col("start").alias("node")).distinct(),
        terminals.where("in_service").select(one, F.col("id").alias("node")),
        most,
    )
    state = ways.join(terminals.select(F.col("id").alias("node"), "in_service"), "node", "left").join(couplers.select(F.col("id").cast("string").alias("via"), "closed"), "via", "left")
    state = settle(state.select(F.col("label").alias("start"), "step", F.col("via").alias("coupler"), F.col("node").alias("terminal"), (F.col("via").isNotNull() & ~F.coalesce("closed", F.lit(False))).alias("closes"), (~F.coalesce("in_service", F.lit(False))).alias("restores")), "steps")
    return ends.join(state, "start").select("line", "side", "start", "step", "coupler", "terminal", "closes", "restores")


def plans(lines: DataFrame, ways: DataFrame, switches: DataFrame) -> DataFrame:
    """line, ready, n_ways, closes, restores, blockers: lists in order, each item once; ways are the rows of steps.

    switches (id, line, closed, in_service) are the lines' own. Blockers: NO_PATH:<side> of an end without a way, and
    OUT_OF_SERVICE:<switch>. Ready with two ways and no blocker. Lists of a line are as long as two ways and its switches."""
    item = lambda rows, kind, text: rows.select("line", F.lit(kind).alias("kind"), text.cast("string").alias("item"))
    sides = lines.select(F.col("id").alias("line"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    lost = sides.join(ways.select("line", "side").distinct(), ["line", "side"], "left_anti")
    own = switches.where("line is not null")
    items = (
        item(ways.where("closes"), "closes", F.col("coupler"))
        .unionByName(item(ways.where("restores"), "restores", F.col("terminal")))
        .unionByName(item(ways.where("step = 0"), "ways", F.col("side")))
        .unionByName(item(own.where("in_service and not closed"), "closes", F.concat(F.lit("S"), "id")))
        .unionByName(item(own.where("not in_service"), "blockers", F.concat(F.lit("OUT_OF_SERVICE:"), "id")))
        .unionByName(item(lost, "blockers", F.concat(F.lit("NO_PATH:"), "side")))
    )
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item")))).alias(kind)
    per = items.groupBy("line").agg(*map(of, ("ways", "closes", "restores", "blockers")))
    return per.select("line", ((F.size("ways") == 2) & (F.size("blockers") == 0)).alias("ready"), F.size("ways").alias("n_ways"), "closes", "restores", "blockers")
