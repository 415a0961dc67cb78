"""Overlays folded from a log of operations: who holds an item when, and what was valid at any time.

An owner's operation takes items one by one; taking one that it already holds changes nothing. Its rollback gives all of them
back. Of several holders the one that has held the item longest is in charge; when it gives the item back, the next one is,
and only when nobody holds it any more does the item return to its source state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators.scans import before
from voltspan.operators.tables import settle

_OPEN = (1 << 63) - 1


def holdings(log: DataFrame) -> DataFrame:
    """owner, item, start, end of log (at: the place in the log, owner, item, rollback); end is null while held."""
    ended = before(log, ["owner"], ["at"], F.when(F.col("rollback"), F.col("at")), "after")
    ended = before(ended, ["owner"], [F.col("at").desc()], F.when(F.col("rollback"), F.col("at")), "end")
    return ended.where("not rollback and item is not null").groupBy("owner", "item", "after", "end").agg(F.min("at").alias("start")).select("owner", "item", "start", "end")


def versions(held: DataFrame) -> DataFrame:
    """item, owner, start, valid_from, valid_to, from_owner: who is in charge of an item from when to when; held are holdings.

    A holder is in charge once all that took the item before have given it back: from the greatest of their ends on. from_owner
    is who hands over, null where the item was free."""
    end = F.coalesce("end", F.lit(_OPEN))
    free = before(held, ["item"], ["start", "owner"], end, "free", "max")
    mine = free.withColumn("valid_from", F.greatest("start", F.coalesce("free", "start"))).where(F.col("valid_from") < end)
    mine = mine.select("item", "owner", "start", "valid_from", F.col("end").alias("valid_to"))
    last = before(mine, ["item"], ["valid_from"], F.struct(F.coalesce("valid_to", F.lit(_OPEN)).alias("to"), "owner"), "_before")
    return last.withColumn("from_owner", F.when(F.col("_before.to") == F.col("valid_from"), F.col("_before.owner"))).drop("_before")


def as_of(probes: DataFrame, key: str, at: Column, of: DataFrame, columns: list[str]) -> DataFrame:
    """probes with columns of the version (item, valid_from, valid_to) that was valid for key at that place, or null.

    Versions and probes are sorted together, so neither side is copied, and a key with many probes spans several tasks."""
    versions = of.select(F.col("item").alias("_item"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.coalesce("valid_to", F.lit(_OPEN)).alias("_to"), *columns).alias("_version"))
    asked = probes.select(F.col(key).alias("_item"), at.alias("_at"), F.lit(1).alias("_kind"), F.struct(*probes.columns).alias("_probe"))
    both = settle(versions.unionByName(asked, allowMissingColumns=True), "asof")
    found = before(both, ["_item"], ["_at", "_kind"], F.col("_version"), "_found").where("_kind = 1")
    valid = F.col("_found._to") > F.col("_at")
    return found.select("_probe.*", *[F.when(valid, F.col(f"_found.{c}")).alias(c) for c in columns])
