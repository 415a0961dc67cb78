"""Catalog operators: search, bands, sorting, paging, and joins with explicit rules for what is missing or ambiguous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by spaces and lower-cased by Turkish rules, contain the text."""
    joined = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    return df.where(F.contains(F.lower(F.collate(joined, "tr")), F.lower(F.collate(F.trim(F.lit(text)), "tr")))) if text.strip() else df


def band(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The band whose lower edge is the largest one that value reaches; null where value is null."""
    out = F.when(value.isNull(), None)
    for edge, name in sorted(zip(edges, names, strict=True), reverse=True):
        out = out.when(value >= edge, name)
    return out


def band_filter(df: DataFrame, column: Column, wanted: Sequence[str], every: Sequence[str]) -> DataFrame:
    """All bands: no filter, unknown values stay. A part of them: unknown values go."""
    return df if set(every) <= set(wanted) else df.where(column.isin(*wanted))


def overlapping(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | value.between(low, high)
    return out


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 20) -> DataFrame:
    """A page of the global order; size is clamped to 1 to 100, page numbers begin at 0."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset(max(0, number) * size).limit(size)


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def unambiguous_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to rows of right whose key occurs once; an ambiguous key matches nothing."""
    once = right.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in right.columns if c != key)).where("_n = 1").drop("_n")
    return left.join(once, key, "left")


def overlay(base: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Overrides (key, column) win over the base."""
    o = overrides.select(key, F.col(column).alias("_new"))
    return base.join(o, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def full_delta(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Union of keys with state COMPARED, ADDED or REMOVED; the difference of compared ones only."""
    both = base.select(key, F.col(value).alias("base")).join(other.select(key, F.col(value).alias("other")), key, "full_outer")
    state = F.when(F.col("base").isNull(), "ADDED").when(F.col("other").isNull(), "REMOVED").otherwise("COMPARED")
    return both.withColumn("state", state).withColumn("delta", F.col("other") - F.col("base"))


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def shares(df: DataFrame, key: str, value: str) -> DataFrame:
    """Participation: negative values count as 0; a group without any weight is shared evenly."""
    clipped = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    total = df.groupBy(F.col(key).alias("_key")).agg(F.sum(clipped).alias("_total"), F.count("*").alias("_n"))
    joined = df.join(total, F.col(key).eqNullSafe(F.col("_key")))
    share = F.when(F.col("_total") > 1e-9, clipped / F.col("_total")).otherwise(F.lit(1.0) / F.col("_n"))
    return joined.withColumn("share", share).drop("_key", "_total", "_n")


def interpolated(df: DataFrame, curve: DataFrame, key: str, at: str, x: str, y: str) -> DataFrame:
    """Adds value: the curve of the row's key at a place, linear between its points and level beyond them.

    A curve has few points, so a key's are one array; rows are never sorted.
    """
    points = curve.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_points"))
    joined = df.join(points, key, "left")
    low = F.try_element_at(F.filter("_points", lambda p: p["x"] <= F.col(at)), F.lit(-1))
    high = F.try_element_at(F.filter("_points", lambda p: p["x"] >= F.col(at)), F.lit(1))
    joined = joined.withColumns({"_low": low, "_high": high})
    t = F.least(F.greatest(F.try_divide(F.col(at) - F.col("_low.x"), F.col("_high.x") - F.col("_low.x")), F.lit(0.0)), F.lit(1.0))
    value = F.when(F.col("_low").isNull(), F.col("_high.y")).when(F.col("_high").isNull() | (F.col("_high.x") == F.col("_low.x")), F.col("_low.y"))
    return joined.withColumn("value", value.otherwise(F.col("_low.y") + (F.col("_high.y") - F.col("_low.y")) * t)).drop("_points", "_low", "_high")
