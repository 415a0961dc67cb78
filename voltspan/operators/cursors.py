"""Pages of a whole order, bound to a snapshot: a page of a table that has changed since is refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators.digests import DIGEST, digests
from voltspan.operators.tables import settle
from voltspan.operators.tours import numbered


class Stale(ValueError):
    """The table is not the one that the snapshot was taken of."""


def identity(df: DataFrame) -> tuple:
    """The digest of all rows and columns, however ordered."""
    row = digests(df.withColumn("_all", F.lit(1)), ["_all"], df.columns).first()
    return tuple(row[c] for c in DIGEST) if row else (0,)


@dataclass(frozen=True)
class Snapshot:
    """rows with pos, sorted, so that a page of any depth is a span of numbers that the scan skips to."""

    identity: tuple
    rows: DataFrame
    total: int

    def check(self, live: DataFrame) -> None:
        if identity(live) != self.identity:
            raise Stale("the table has changed since the first page")

    def page(self, live: DataFrame, number: int, size: int) -> DataFrame:
        """Page number (from 0) of so many rows, in order."""
        self.check(live)
        return self.rows.where(F.col("pos").between(number * size, (number + 1) * size - 1)).orderBy("pos").drop("pos")

    def pages(self, live: DataFrame, size: int) -> DataFrame:
        """All rows with page and place, as fetching page after page gives them."""
        self.check(live)
        return self.rows.withColumns({"page": F.floor(F.col("pos") / size), "place": F.col("pos") % size}).drop("pos")


def snapshot(df: DataFrame, *order: Column | str) -> Snapshot:
    """order should tell all rows apart, else rows that agree come in any, but for this snapshot fixed order."""
    rows = settle(numbered(df, *order).sortWithinPartitions("pos"), "snapshot")
    return Snapshot(identity(df), rows, rows.count())
