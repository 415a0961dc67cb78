"""Digests of tables that do not depend on the order of rows, and trees of them that lead to the rows that differ.

A row's digest is its SHA-256 in four pieces of 60 bits; a table's is the number of rows and the sums of the pieces, so digests of
parts add up, map-side first, and repeated rows count. A tree groups rows by leading hex digits of their key's hash, one more a
level. Two trees are compared from the root down, and only children of groups that differ are looked at; only rows in leaves that
differ are then compared by key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators.tables import settle

PIECES = [f"s{i}" for i in range(4)]
DIGEST = ["n", *PIECES]
#: Rows in a leaf, about; from it follow a tree's levels.
LEAF = 20_000


def _text(columns: list[str]) -> Column:
    """Columns as one text: each value behind its length, so that no two rows share a text; null is a mark of its own."""
    value = lambda c: F.col(c).cast("string")
    return F.concat(*[F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("~")) for c in columns])


def pieces(text: Column) -> list[Column]:
    """Four numbers of 60 bits of a text's SHA-256."""
    return [F.conv(F.substring(F.sha2(text, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(p) for i, p in enumerate(PIECES)]


def digests(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, and n, s0 ... s3 of the rows of each of its values."""
    rows = df.select(*by, *pieces(_text(columns)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(p).alias(p) for p in PIECES])


def same(a: str, b: str) -> Column:
    """True if the digests that two structs hold agree; a missing one agrees with none."""
    return functools.reduce(Column.__and__, [F.coalesce(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), F.lit(False)) for c in DIGEST])


def depth(rows: int) -> int:
    return max(1, -(-max(1, rows // LEAF).bit_length() // 4))


def _leafed(df: DataFrame, keys: list[str], levels: int) -> DataFrame:
    return df.withColumn("_leaf", F.substring(F.sha2(_text(keys), 256), 1, levels))


def tree(df: DataFrame, keys: list[str], columns: list[str], levels: int) -> DataFrame:
    """level, node, n, s0 ... s3: nodes are prefixes of the hash of keys, from none (level 0) to so many hex digits."""
    leaves = settle(digests(_leafed(df, keys, levels), ["_leaf"], [*keys, *columns]), "leaves")
    at = [leaves.select(F.lit(k).alias("level"), F.substring("_leaf", 1, k).alias("node"), *DIGEST) for k in range(levels)]
    inner = [x.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in DIGEST]) for x in at]
    whole = functools.reduce(DataFrame.unionByName, [*inner, leaves.select(F.lit(levels).alias("level"), F.col("_leaf").alias("node"), *DIGEST)])
    return settle(whole, "tree")


def differing(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """node of the leaves in which two trees differ."""
    live = None
    for k in range(levels + 1):
        sides = []
        for name, side in (("a", a), ("b", b)):
            rows = side.where(F.col("level") == k)
            if live is not None:
                rows = rows.join(live.select(F.col("node").alias("_up")), F.substring("node", 1, k - 1) == F.col("_up"), "left_semi")
            sides.append(rows.select("node", F.struct(*DIGEST).alias(name)))
        live = sides[0].join(sides[1], "node", "full").where(~same("a", "b")).select("node")
    return live


def changes(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and state of the keys whose rows differ: REMOVED if only a has them, ADDED if only b has, else CHANGED."""
    levels = depth(max(a.count(), b.count()))
    leaves = settle(differing(tree(a, keys, columns, levels), tree(b, keys, columns, levels), levels), "differing")
    side = lambda df, name: digests(_leafed(df, keys, levels).join(leaves.select(F.col("node").alias("_leaf")), "_leaf", "left_semi"), keys, columns).select(_text(keys).alias("_key"), F.struct(*keys).alias(f"k{name}"), F.struct(*DIGEST).alias(name))
    both = side(a, "a").join(side(b, "b"), "_key", "full").where(~same("a", "b"))
    key = F.coalesce("ka", "kb")
    return both.select(*[key[k].alias(k) for k in keys], F.when(F.col("b").isNull(), "REMOVED").when(F.col("a").isNull(), "ADDED").otherwise("CHANGED").alias("state"))


def slot_status(previous: DataFrame, incoming: DataFrame, slot: list[str], columns: list[str]) -> DataFrame:
    """slot, status, n_previous, n_incoming: whether a slot's two tables hold the same rows, however ordered."""
    side = lambda df, name: digests(df, slot, columns).select(*slot, F.struct(*DIGEST).alias(name))
    both = side(previous, "a").join(side(incoming, "b"), slot, "full")
    status = F.when(F.col("b").isNull(), "ONLY_PREVIOUS").when(F.col("a").isNull(), "ONLY_INCOMING").when(same("a", "b"), "EQUAL").otherwise("DIFFERS")
    count = lambda c: F.coalesce(f"{c}.n", F.lit(0).cast("long"))
    return both.select(*slot, status.alias("status"), count("a").alias("n_previous"), count("b").alias("n_incoming"))


def merged_slots(previous: DataFrame, incoming: DataFrame, package: str) -> DataFrame:
    """package, slot, taken_from, reason of merging slots; previous and incoming (package, slot, field, value) are their identities.

    A package is refused if a field of any slot that it has differs from that of the first incoming slot; else each slot comes
    from the incoming package if it is there, and stays as it was if not. reason: the first slot and field that differ."""
    long = lambda df: df.select(package, "slot", "field", "value")
    first = incoming.groupBy(package).agg(F.min("slot").alias("slot"))
    asked = long(incoming).join(first, [package, "slot"]).select(package, "field", F.col("value").alias("_asked"))
    wrong = long(previous).join(asked, [package, "field"]).where(~F.col("value").eqNullSafe(F.col("_asked")))
    wrong = wrong.groupBy(package).agg(F.min(F.struct("slot", "field")).alias("_wrong"))
    slots = previous.select(package, "slot", F.lit(False).alias("new")).unionByName(incoming.select(package, "slot", F.lit(True).alias("new"))).groupBy(package, "slot").agg(F.max("new").alias("new"))
    refused = F.col("_wrong").isNotNull()
    return slots.join(wrong, package, "left").select(package, "slot", F.when(refused, "REFUSED").when(F.col("new"), "INCOMING").otherwise("PREVIOUS").alias("taken_from"), F.when(refused, F.concat_ws(" ", "_wrong.slot", "_wrong.field")).alias("reason"))


def preflight(cases: DataFrame, model: Column, reference: Column, study: Column, method: Column, result: Column, identity: Column) -> DataFrame:
    """cases with status and reason: the first gate that does not hold, in this order; with all of them, COMPARABLE_PARTIAL."""
    fails = [
        (model, "NOT_COMPARABLE", "MODEL_NOT_LOADED"),
        (reference, "NOT_COMPARABLE", "LF_REFERENCE_NOT_LOADED"),
        (study, "BLOCKED", "MODEL_STUDY_CASE_MISMATCH"),
        (method, "NOT_COMPARABLE", "LF_METHOD_UNVERIFIED"),
        (result, "NOT_COMPARABLE", "GA_NOT_CALCULATED"),
        (identity, "EXPLORATORY_ONLY", "IDENTITY_NOT_VERIFIED"),
    ]
    # What is unknown does not hold.
    holds = lambda c: F.coalesce(c, F.lit(False))
    status, reason = F.lit("COMPARABLE_PARTIAL"), F.lit(None).cast("string")
    for gate, s, r in reversed(fails):
        status, reason = F.when(~holds(gate), s).otherwise(status), F.when(~holds(gate), r).otherwise(reason)
    return cases.withColumns({"status": status, "reason": reason})
