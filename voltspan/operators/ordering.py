"""Orders with rules for what is missing, mixed types and ties; pages, ranks and occurrence numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def mixed(text: Column, descending: bool = False) -> list[Column]:
    """Order of cells that may look like numbers: numbers before other text, missing ones last whatever the direction.

    The direction turns only the values of a kind around; ties are for the caller to settle, in ascending order.
    """
    trimmed = F.trim(text)
    number = F.when(F.regexp_like(trimmed, F.lit(NUMBER)), trimmed.try_cast("double"))
    kind = F.when(text.isNull() | (trimmed == ""), 2).when(number.isNotNull(), 0).otherwise(1)
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    # Turned around, text comes before numbers.
    lead = F.when(kind == 2, 2).otherwise(1 - kind if descending else kind)
    return [lead.asc(), turn(number), turn(F.when(kind == 1, trimmed))]


def natural(text: Column, width: int = 20) -> Column:
    """A text whose plain order is the natural one: its runs of digits are padded."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d+)", "0" * width + "$1"), r"0*(\d{" + str(width) + r"})(?!\d)", "$1")


def by_size(value: Column, descending: bool = True) -> Column:
    """Signed flows compare by size; missing ones come last."""
    return F.abs(value).desc_nulls_last() if descending else F.abs(value).asc_nulls_last()


def missing_as(value: Column, stand_in: float = -1.0) -> Column:
    return F.coalesce(value, F.lit(stand_in))


def ranked(value: Column, order: Sequence[str]) -> Column:
    """Place of a value in a list; others come behind."""
    return reduce(lambda out, x: F.when(value == x[1], x[0]).otherwise(out), reversed(list(enumerate(order))), F.lit(len(order)))


def bounded_page(df: DataFrame, order: Sequence[Column], number: int, size: int = 50) -> DataFrame:
    """A page; numbers past the last page give the last one."""
    last = max(0, (df.count() - 1) // size)
    return df.orderBy(*order).offset(min(max(number, 0), last) * size).limit(size)


def merged_page(parts: dict[str, DataFrame], order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page of the order of several classes together."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("class", F.lit(k)) for k, df in parts.items()))
    return every.orderBy(*order).offset(number * size).limit(size)


def first_matches(df: DataFrame, order: Sequence[Column], k: int = 50) -> DataFrame:
    """The first k rows, each with the total of rows."""
    total = df.agg(F.count("*").cast("long").alias("total"))
    return df.orderBy(*order).limit(k).join(total)


def interleaved(df: DataFrame, kind: Column, order: Sequence[Column], first: Sequence[str], k: int) -> DataFrame:
    """A queue of k rows that takes the kinds by turns, each in its own order."""
    top = df.withColumn("_kind", kind)
    top = top.withColumn("_turn", F.row_number().over(Window.partitionBy("_kind").orderBy(*order))).where(F.col("_turn") <= k)
    queue = top.orderBy("_turn", ranked(F.col("_kind"), first)).limit(k)
    place = F.row_number().over(Window.orderBy("_turn", ranked(F.col("_kind"), first))).cast("long")
    return queue.withColumn("place", place).drop("_kind", "_turn")


def occurrence(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Names of repeated keys: the key, then key:2, key:3 in the given order."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(name, F.when(k == 1, F.col(key).cast("string")).otherwise(F.concat_ws(":", key, k)))


def parallels(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """index (from 0) and count of the rows of a key."""
    w = Window.partitionBy(key)
    return df.withColumn("index", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("count", F.count("*").over(w))
