"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._io import partitions

#: A key is hot if it holds more than this part of a task's fair share, and more than FEW rows; so at most PART x tasks are.
PART, FEW = 4, 500


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key. Rows of a hot key are dealt over several tasks by spread.

    left is read three times and should be a table. The list of hot keys is bounded by PART times the number of tasks, and the
    copies of right's rows by as many again.
    """
    spark = left.sparkSession
    share = max(FEW, left.count() // (PART * max(2, partitions(spark))))
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > share) & F.col(key).isNotNull())
    hot = [(r[0], -(-r[1] // share)) for r in hot.collect()]
    if not hot:
        return left.join(right, key, how)
    salts = F.broadcast(spark.createDataFrame(hot, f"{key} {right.schema[key].dataType.simpleString()}, _salts long"))
    a = left.join(salts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    b = right.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def join_counted(left: DataFrame, right: DataFrame, key: str, spread: str, count: str, total: int, how: str = "inner", parts: int | None = None) -> DataFrame:
    """join_hot where right's count already says how many of left's total rows each key has; left is read once.

    Hot keys are told from right alone, and there are at most PART times the number of tasks of them, so that their list can
    be broadcast. right should be a table. parts: into how many parts both sides are dealt, if not by Spark's own choice.
    """
    spark = left.sparkSession
    share = max(FEW, total // (PART * max(2, parts or partitions(spark))))
    salts = F.ceil(F.col(count) / share)
    hot = F.broadcast(right.where(F.col(count) > share).select(key, salts.alias("_salts")))
    a = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(count) > share, salts).otherwise(1) - 1)))
    if parts:
        a, b = (x.repartition(parts, key, "_salt") for x in (a, b))
    return a.join(b, [key, "_salt"], how).drop("_salt")
