"""Shares of units in a group's total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(units: DataFrame, group: str, weight: str, cap: str, total: Column) -> DataFrame:
    """Water-filling: share = min(cap, level * weight) with the level at which a group's shares add up to total, or all at their
    caps where that isn't enough. total is an aggregate over the group.

    Units reach their caps in order of cap / weight; the level is the first one that is consistent with the units before it full.
    """
    ratio = F.col(cap) / F.col(weight)
    of = units.groupBy(F.col(group).alias("_g")).agg(F.least(total, F.sum(cap)).alias("_total"), F.max(ratio).alias("_most"))
    w = Window.partitionBy(group).orderBy(ratio, "id")
    below = F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum(weight).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = units.withColumns({"_below": below, "_above": above, "_place": F.row_number().over(w)}).join(of, F.col(group) == F.col("_g"))
    rows = rows.withColumn("_level", (F.col("_total") - F.col("_below")) / F.col("_above"))
    level = rows.groupBy("_g").agg(F.coalesce(F.min(F.when(F.col("_level") <= ratio * (1 + 1e-12), F.struct("_place", "_level")))["_level"], F.max("_most")).alias("_found"))
    return rows.join(level, "_g").withColumn("share", F.least(F.col(cap), F.col("_found") * F.col(weight))).drop("_g", "_total", "_most", "_below", "_above", "_place", "_level", "_found")


def participation(units: DataFrame, group: str, percent: str, dispatched: str) -> DataFrame:
    """share and explicit: by percentages where a group has all of them and they add up to something, else by dispatch, else evenly."""
    of = units.groupBy(F.col(group).alias("_g")).agg((F.bool_and(F.col(percent).isNotNull() & (F.col(percent) >= 0)) & (F.sum(percent) > 1e-9)).alias("explicit"), F.sum(percent).alias("_pct"), F.sum(dispatched).alias("_p"), F.count("*").alias("_n"))
    share = F.when(F.col("explicit"), F.col(percent) / F.col("_pct")).when(F.col("_p") > 1e-9, F.col(dispatched) / F.col("_p")).otherwise(1.0 / F.col("_n"))
    return units.join(of, F.col(group) == F.col("_g")).withColumn("share", share).drop("_g", "_pct", "_p", "_n")
