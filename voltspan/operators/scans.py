"""Running values within keys that need no task for a whole key.

Rows are range-sorted by key and order, so a key with many rows spans several partitions. Each partition runs over its own part;
what it hands on to the next ones is one value, and these are folded on the driver, one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltspan.operators.tables import settle


def before(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, name: str, how: str = "last") -> DataFrame:
    """df with name: of the rows of equal keys that come before in order, the last value that is not null, or the greatest.

    how: last or max. Null keys are a key of their own. Rows that agree in keys and order come in any order.
    """
    spark = df.sparkSession
    rows = df.withColumn("_v", value)
    held = settle(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_seq", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_seq", 33)).withColumn("_key", F.struct(*keys)), "scan")
    w = Window.partitionBy("_part", "_key").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.max("_v").over(w) if how == "max" else F.last("_v", ignorenulls=True).over(w)
    ends = held.groupBy("_part").agg(F.min_by("_key", "_seq").alias("_first"), F.max_by("_key", "_seq").alias("_last"))
    last = F.max("_v") if how == "max" else F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_seq")))
    tails = held.join(F.broadcast(ends.select("_part", "_last")), "_part").where(F.col("_key").eqNullSafe(F.col("_last"))).groupBy("_part").agg(last.alias("_tail"))
    carried, key, rows_of = None, None, []
    for e in ends.join(tails, "_part").orderBy("_part").collect():
        here = carried if key is not None and e["_first"] == key else None
        rows_of.append((e["_part"], e["_first"], here))
        alone = e["_first"] == e["_last"]
        tail = e["_tail"]
        if alone and here is not None:
            tail = here if tail is None else max(here, tail) if how == "max" else tail
        carried, key = tail, e["_last"]
    schema = held.select("_part", F.col("_key").alias("_first"), F.col("_v").alias("_carried")).schema
    for f in schema:
        f.nullable = True
    of = F.broadcast(spark.createDataFrame(rows_of, schema))
    mine = F.when(F.col("_key").eqNullSafe(F.col("_first")), F.col("_carried"))
    value = F.greatest(inner, mine) if how == "max" else F.coalesce(inner, mine)
    return held.join(of, "_part").withColumn(name, value).drop("_v", "_seq", "_part", "_key", "_first", "_carried")
