"""Map layers: gates of a selection, values by site and branch, and cells of a space-filling curve to read them by.

A cell's key interleaves the bits of its column and row, so that cells of a square that the grid halves into are one span of keys:
a range-sorted layer is read by viewport with a few spans, and points and branches meet by equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators.tours import numbered, running

#: Geographic bounds within which coordinates count (fixed values).
SOUTH, NORTH, WEST, EAST = 30.0, 46.0, 25.0, 46.0
LEVEL = 6


def located(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(SOUTH, NORTH) & lon.between(WEST, EAST), F.lit(False))


def column(lon: Column, level: int = LEVEL) -> Column:
    """The grid's column of a longitude within bounds; the eastern edge belongs to the last one."""
    return F.least(F.floor((lon - WEST) / (EAST - WEST) * (1 << level)), F.lit((1 << level) - 1).cast("long"))


def row(lat: Column, level: int = LEVEL) -> Column:
    return F.least(F.floor((lat - SOUTH) / (NORTH - SOUTH) * (1 << level)), F.lit((1 << level) - 1).cast("long"))


def key(x: Column, y: Column, level: int = LEVEL) -> Column:
    """Bits of y and x in turn, the highest first."""
    out = F.lit(0).cast("long")
    for b in range(level):
        bit = lambda v: F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long"))  # noqa: B023,E731
        out = out + bit(x) * (1 << (2 * b)) + bit(y) * (1 << (2 * b + 1))
    return out


def crossed(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Cells (x, y) that a straight way passes in steps of one cell along its longer side; halves are rounded up."""
    n = F.greatest(F.abs(x1 - x0), F.abs(y1 - y0))
    at = lambda a, b, i: F.when(n == 0, a).otherwise(a + F.floor((2 * i * (b - a) + n) / (2 * n)))
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.struct(at(x0, x1, i).alias("x"), at(y0, y1, i).alias("y")))


def gated(selections: DataFrame) -> DataFrame:
    """selections with enabled and reason; the first gate that is shut gives the reason.

    Columns: analysis (LF, N1, SC), source (GA, PF, DELTA, EXPLORATORY_DELTA, SCENARIO_DELTA), metric, sc_min, diagnostic, and what is
    there: model, reference, slot, lf_current, sc_current, n1_current, n1_post, scenario_changed, comparable, matched (all boolean;
    null is false)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    analysis, source = F.col("analysis"), F.col("source")
    explore, sc, n1, lf = source == "EXPLORATORY_DELTA", analysis == "SC", analysis == "N1", analysis == "LF"
    shut = [
        (~flag("model"), "MODEL_NOT_LOADED"),
        ((source == "SCENARIO_DELTA") & ~(lf & flag("lf_current") & flag("scenario_changed")), "GA_LF_NOT_CALCULATED_OR_STALE"),
        ((source == "SCENARIO_DELTA"), None),
        ((source != "GA") & ~flag("reference"), "PF_NOT_LOADED"),
        ((source != "GA") & ~flag("slot"), "PF_REFERENCE_SLOT_NOT_LOADED"),
        (explore & ~flag("diagnostic"), "DIAGNOSTIC_OPT_IN_REQUIRED"),
        (explore & lf & ~flag("lf_current"), "GA_LF_NOT_CALCULATED_OR_STALE"),
        (explore & flag("scenario_changed"), "PF_SCENARIO_IDENTITY_UNVERIFIED"),
        (explore & ~flag("matched"), "NO_IDENTITY_MATCHED_DIAGNOSTIC_CELLS"),
        (explore, None),
        (sc & (source == "DELTA"), "GA_IEC60909_METHOD_AND_EDITION_UNVERIFIED"),
        (sc & (source == "PF") & (F.col("metric") == "skssMva"), "PF_SKSS_REFERENCE_NOT_AVAILABLE"),
        (sc & (source == "PF") & flag("sc_min"), "PF_SC_MIN_REFERENCE_NOT_AVAILABLE"),
        (sc & (source == "GA") & ~flag("sc_current"), "GA_IEC60909_NOT_COMPUTABLE"),
        (sc & (source == "GA") & ~F.col("metric").isin("ikssKa", "maxIkssKa", "ikss3FKa", "skssMva"), "SC_METRIC_NOT_IMPLEMENTED"),
        (n1 & (source == "DELTA"), "NOT_COMPARABLE_PF_MISSING"),
        (lf & (source == "GA") & ~flag("lf_current"), "GA_LF_NOT_CALCULATED"),
        (lf & (source == "DELTA") & ~flag("lf_current"), "GA_LF_NOT_CALCULATED_OR_STALE"),
        (lf & (source == "DELTA") & ~flag("comparable"), "METHOD_MISMATCH"),
        (n1 & (source == "GA") & ~flag("n1_post") & ~flag("n1_current"), "GA_N1_NOT_CALCULATED_OR_STALE"),
        (n1 & (source == "GA") & ~flag("n1_post") & ~F.col("metric").isin("postLoadingPercent", "postPmw"), "GA_DC_P_ONLY"),
    ]
    reason = F.lit("")
    for gate, why in reversed(shut):
        reason = F.when(gate, why or "").otherwise(reason)
    return selections.withColumns({"reason": reason, "enabled": reason == ""})


def site_layer(values: DataFrame, sites: DataFrame, delta: bool = False, level: int = LEVEL) -> DataFrame:
    """cell, site, value, fid, low, high, n, levels of values (site, fid, kv, value) and sites (site, lat, lon).

    value: the one farthest from 1 (delta: from 0), of equally far ones that of the least fid. levels: by nominal voltage the least and
    greatest value. Sites without coordinates within bounds have no cell; sites without values have none but their place."""
    far = F.abs(F.col("value") - (0 if delta else 1))
    # Values are first summed up by site and level, so a site with most of the rows crosses the exchange once a task.
    by_level = values.where("value is not null").groupBy("site", F.coalesce(F.col("kv").cast("int").cast("string"), F.lit("UNKNOWN")).alias("kv")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.min_by(F.struct("value", "fid"), F.struct(-far, "fid")).alias("worst"))
    per = by_level.groupBy("site").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.min_by("worst", F.struct(-F.abs(F.col("worst.value") - (0 if delta else 1)), "worst.fid")).alias("worst"), F.array_sort(F.collect_list(F.struct("kv", "low", "high"))).alias("levels"))
    cell = F.when(located(F.col("lat"), F.col("lon")), key(column(F.col("lon"), level), row(F.col("lat"), level), level))
    return sites.join(per, "site", "left").select(cell.alias("cell"), "site", F.col("worst.value").alias("value"), F.col("worst.fid").alias("fid"), "low", "high", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "levels")


def branch_layer(branches: DataFrame, sites: DataFrame, level: int = LEVEL) -> DataFrame:
    """cell, part and branches' columns (a and b are their sites): a row for each cell that a branch passes, in order from a.

    A branch of which an end has no place within bounds has one row without a cell."""
    end = lambda c: sites.select(F.col("site").alias(c), F.when(located(F.col("lat"), F.col("lon")), F.struct(column(F.col("lon"), level).alias("x"), row(F.col("lat"), level).alias("y"))).alias(f"_{c}"))
    placed = branches.join(end("a"), "a", "left").join(end("b"), "b", "left")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    # Places on the way are told after they have become rows, in compiled code; a lambda over arrays is interpreted.
    ends = placed.select(*branches.columns, *[F.when(whole, F.col(f"_{c}.{d}")).alias(f"_{c}{d}") for c in "ab" for d in "xy"])
    n = F.greatest(F.abs(F.col("_bx") - F.col("_ax")), F.abs(F.col("_by") - F.col("_ay")))
    steps = ends.select("*", n.alias("_n"), F.explode_outer(F.sequence(F.lit(0).cast("long"), n)).alias("_i"))
    at = lambda d: F.when(F.col("_n") == 0, F.col(f"_a{d}")).otherwise(F.col(f"_a{d}") + F.floor((2 * F.col("_i") * (F.col(f"_b{d}") - F.col(f"_a{d}")) + F.col("_n")) / (2 * F.col("_n"))))
    cells = steps.select(at("x").alias("_x"), at("y").alias("_y"), F.col("_i").cast("int").alias("part"), *branches.columns)
    return cells.select(F.when(F.col("part").isNotNull(), key(F.col("_x"), F.col("_y"), level)).alias("cell"), "part", *branches.columns)


def passed(sites: DataFrame, branches: DataFrame, level: int = LEVEL) -> DataFrame:
    """site, n, value: how many branches pass the cell of each placed site without ending there, and their greatest value.

    branches are rows of branch_layer. They are summed up by cell, and those that end at a site taken off by site and cell, so that
    a cell with many sites and branches is never paired out. A site has a greatest value only if it has no branch of its own there."""
    cells = branches.where("cell is not null").groupBy("cell").agg(F.count("*").alias("_n"), F.max("value").alias("_value"))
    own = branches.where("cell is not null").select("cell", F.explode(F.array_distinct(F.array("a", "b"))).alias("site")).groupBy("cell", "site").agg(F.count("*").alias("_own"))
    at = sites.where(located(F.col("lat"), F.col("lon"))).select("site", key(column(F.col("lon"), level), row(F.col("lat"), level), level).alias("cell"))
    met = at.join(cells, "cell").join(own, ["cell", "site"], "left")
    return met.select("cell", "site", (F.col("_n") - F.coalesce("_own", F.lit(0).cast("long"))).alias("n"), F.when(F.col("_own").isNull(), F.col("_value")).alias("value"))


def passing(sites: DataFrame, branches: DataFrame, level: int = LEVEL) -> DataFrame:
    """cell, site, n, value as passed gives them, from branches (a, b, value) that are not yet laid out in cells.

    A way depends on the cells of its ends only, so branches are summed up by those before ways are laid out: at most one way for two
    cells. A branch is in the cell of a site that it ends at exactly once."""
    end = lambda c: sites.where(located(F.col("lat"), F.col("lon"))).select(F.col("site").alias(c), column(F.col("lon"), level).alias(f"{c}x"), row(F.col("lat"), level).alias(f"{c}y"))
    placed = branches.select("a", "b", "value").join(end("a"), "a").join(end("b"), "b")
    ways = placed.groupBy("ax", "ay", "bx", "by").agg(F.count("*").alias("k"), F.max("value").alias("value"))
    laid = ways.select("k", "value", F.explode(crossed(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("c"))
    cells = laid.groupBy(key(F.col("c.x"), F.col("c.y"), level).alias("cell")).agg(F.sum("k").alias("_n"), F.max("value").alias("_value"))
    own = placed.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("site")).groupBy("site").agg(F.count("*").alias("_own"))
    at = sites.where(located(F.col("lat"), F.col("lon"))).select("site", key(column(F.col("lon"), level), row(F.col("lat"), level), level).alias("cell"))
    met = at.join(cells, "cell").join(own, "site", "left")
    return met.select("cell", "site", (F.col("_n") - F.coalesce("_own", F.lit(0).cast("long"))).alias("n"), F.when(F.col("_own").isNull(), F.col("_value")).alias("value"))


def scale(values: DataFrame) -> DataFrame:
    """p95, low, high of values (value): the ceil(0.95 n)-th of the sizes, told from counts of the distinct ones."""
    sizes = values.where("value is not null").groupBy(F.abs("value").alias("size")).agg(F.count("*").alias("n"))
    placed = numbered(sizes, "size")
    up = running(placed, ["n"]).withColumnRenamed("n", "up")
    total = sizes.agg(F.sum("n").alias("total"))
    p95 = placed.join(up, "pos").join(F.broadcast(total)).where(F.col("up") >= F.ceil(F.col("total") * 0.95)).agg(F.min("size").alias("p95"))
    return p95.join(values.agg(F.min("value").alias("low"), F.max("value").alias("high")))
