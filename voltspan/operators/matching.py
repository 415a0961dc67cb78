"""Joins with rules: cascades, single matches, tolerances, priorities, set partitions and references that must exist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unordered(a: Column, b: Column) -> Column:
    """A key that is the same for both directions of a pair."""
    return F.concat_ws("|", F.array_sort(F.array(a.cast("string"), b.cast("string"))))


def cascade(refs: DataFrame, actuals: DataFrame, ref: str, actual: str, keys: Sequence[str]) -> DataFrame:
    """refs and actuals, with the keys as columns -> ref, actual, method.

    Each reference takes the first key that finds anything. More than one actual there, or one that another reference has
    already taken (by an earlier key, or at the same key before it in order of ref), is AMBIGUOUS; no key at all, UNMATCHED.
    """
    hits = None
    for rank, key in enumerate(keys):
        a = actuals.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(actual).alias("_actual"), F.count("*").alias("_n"))
        found = refs.where(F.col(key).isNotNull()).join(a, key).select(F.col(ref), "_actual", "_n", F.lit(rank).alias("_rank"))
        hits = found if hits is None else hits.unionByName(found)
    first = hits.groupBy(ref).agg(F.min_by(F.struct("_actual", "_n", "_rank"), "_rank").alias("h")).select(ref, "h.*")
    single = F.when(F.col("_n") == 1, F.col("_actual"))
    order = Window.partitionBy(single).orderBy("_rank", ref)
    taken = first.withColumn("_place", F.when(F.col("_n") == 1, F.row_number().over(order)))
    method = F.element_at(F.array(*map(F.lit, keys)), F.col("_rank") + 1)
    matched = F.col("_place") == 1
    taken = taken.select(F.col(ref), F.when(matched, F.col("_actual")).alias(actual), F.when(matched, method).otherwise("AMBIGUOUS").alias("method"))
    return refs.select(ref).join(taken, ref, "left").withColumn("method", F.coalesce("method", F.lit("UNMATCHED")))


def require_subset(selected: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The selected rows; an error names a few of those that aren't allowed."""
    wrong = [r[0] for r in selected.join(allowed, key, "left_anti").select(key).orderBy(key).limit(5).collect()]
    if wrong:
        raise ValueError(f"not allowed: {wrong}")
    return selected.join(allowed, key, "left_semi")


def aliases(rows: DataFrame, members: str, name: str) -> DataFrame:
    """One row for each member of a row."""
    return rows.withColumn(name, F.explode(members)).drop(members)


def single_neighbour(links: DataFrame, low: str, high: str) -> DataFrame:
    """low, high of the low nodes that touch just one high node."""
    near = links.groupBy(low).agg(F.count_distinct(high).alias("_n"), F.min(high).alias(high))
    return near.where("_n = 1").drop("_n")


def within_tolerance(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """Pairs with |a - b| < tolerance, by an equi-join on cells of that width and their neighbours."""
    left = left.withColumn("_cell", F.floor(F.col(a) / tolerance))
    right = right.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(b) / tolerance) + d)))
    return left.join(right, "_cell").where(F.abs(F.col(a) - F.col(b)) < tolerance).drop("_cell")


def by_priority(rows: DataFrame, key: Sequence[str], ranks: Sequence[Column], tie: Sequence[str]) -> DataFrame:
    """Of each key the row of the best ranks, ties by the given columns."""
    order = [*ranks, *map(F.asc, tie)]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def partition_audit(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """Two partitions (key, member) of the same kind -> key, reason: how the sets of a key disagree."""
    sets = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(name))
    both = sets(left, "_a").join(sets(right, "_b"), key, "full_outer")
    more, less = F.size(F.array_except("_a", "_b")) > 0, F.size(F.array_except("_b", "_a")) > 0
    reason = F.when(F.col("_a").isNull(), "ONLY_RIGHT").when(F.col("_b").isNull(), "ONLY_LEFT").when(more & less, "OVERLAP").when(more, "LEFT_LARGER").when(less, "RIGHT_LARGER").otherwise("EQUAL")
    return both.select(key, reason.alias("reason"))


def carried(new: DataFrame, prior: DataFrame, key: Sequence[str], same: Sequence[str], values: Sequence[str]) -> DataFrame:
    """new, with values from a prior run where the columns in same agree and new has none."""
    old = prior.select(*key, *(F.col(c).alias(f"_same_{c}") for c in same), *(F.col(c).alias(f"_old_{c}") for c in values))
    joined = new.join(old, list(key), "left")
    ok = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in same))
    kept = {c: F.coalesce(F.col(c), F.when(ok, F.col(f"_old_{c}"))) for c in values}
    return joined.withColumns(kept).drop(*(f"_same_{c}" for c in same), *(f"_old_{c}" for c in values))
