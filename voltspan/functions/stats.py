"""Quantile definitions, error statistics and consistency of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(n p)."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def interpolated(column: str, p: float) -> Column:
    return F.expr(f"percentile_cont({p}) within group (order by {column})")


def at_places(df: DataFrame, key: str, column: str, places: dict[str, Column], buckets: int = 64) -> DataFrame:
    """Per key, the values at places counted from 0 in ascending order; a place may use the count n. Nulls don't count.

    Rows are counted by bucket between approximate quantiles, and only the buckets that hold a wanted place are put in order,
    so no task sorts all rows of a key. Keys are few: what is told of each is broadcast, as a join by key would gather its rows.
    """
    rows = df.where(F.col(column).isNotNull()).select(key, F.col(column).alias("_v"))
    marks = [i / buckets for i in range(1, buckets)]
    bounds = rows.groupBy(key).agg(F.percentile_approx("_v", marks, 4 * buckets).alias("_b"), F.count("*").alias("n"))
    placed = rows.join(F.broadcast(bounds.select(key, "_b")), key).withColumn("_at", F.size(F.filter("_b", lambda x: x < F.col("_v")))).drop("_b")
    sizes = placed.groupBy(key, "_at").agg(F.count("*").alias("_size"))
    below = F.sum("_size").over(Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), v.cast("long").alias("place")) for k, v in places.items()))
    held = sizes.withColumn("_below", below).join(bounds.select(key, wanted.alias("_w")), key)
    held = held.withColumn("_w", F.filter("_w", lambda x: (x["place"] >= F.col("_below")) & (x["place"] < F.col("_below") + F.col("_size")))).where(F.size("_w") > 0)
    ranked = placed.join(F.broadcast(held.select(key, "_at", "_below", "_w")), [key, "_at"]).withColumn("_k", F.col("_below") + F.row_number().over(Window.partitionBy(key, "_at").orderBy("_v")) - 1)
    found = ranked.select(key, "_v", F.explode(F.filter("_w", lambda x: x["place"] == F.col("_k"))).alias("_p"))
    return found.groupBy(key).agg(*(F.max(F.when(F.col("_p.name") == k, F.col("_v"))).alias(k) for k in places))


def absolute_kpi(calculated: str, reference: str) -> list[Column]:
    """Mean of | |a| - |r| | and the same as a share of the sum of |r|; 0 where there is nothing to divide by."""
    error = F.abs(F.abs(calculated) - F.abs(reference))
    total = F.sum(F.abs(reference))
    return [
        F.count("*").cast("long").alias("n"),
        F.coalesce(F.avg(error), F.lit(0.0)).alias("mean_abs"),
        F.when(total > 0, 100 * F.sum(error) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)).alias("normalised"),
        F.avg(F.col(calculated) - F.col(reference)).alias("bias"),
        F.count_if((F.signum(calculated) != F.signum(reference)) & (F.abs(reference) > 1e-6)).cast("long").alias("sign_differs"),
    ]
