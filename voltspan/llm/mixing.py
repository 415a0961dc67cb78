"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. Within a source, the expected copies of a document depend on its size class;
their whole part is certain, and for the rest a Pareto sample is drawn: documents are ranked by random odds divided by
inclusion odds, and the sample is the head of that ranking which holds the wanted number of words. The cut is found on a
histogram of ranks, so only the documents of the one cell that holds the cut are ever put in order.

Nulls: a null source is a source of its own and comes last; a null or empty text has size 0 and gets 0 words. Rows that
repeat a doc_id are documents of their own. An empty table gives an empty mix. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltspan.llm._io import materialise

#: No document is taken more often than this.
MOST_COPIES = 3
#: Documents of 2 ** k to 2 ** (k + 1) - 1 words are asked for in proportion to GENTLE ** k.
GENTLE = 1.05
CELLS = 4096
#: Rows of a few numbers that are broadcast at most.
MOST_BROADCAST = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def _fill(df: DataFrame, by: list[str], weight: str, most: str, total: Column, out: str) -> DataFrame:
    """Adds out = min(most, level * weight), with the level at which the outs of a group add up to total.

    Rows reach their bound in order of most / weight; summing bounds below and weights above a row gives the level that
    holds if just the rows before it are at their bound, and the smallest consistent level is the one looked for.
    """
    ratio = F.when(F.col(weight) > 0, F.col(most) / F.col(weight)).otherwise(F.lit(0.0))
    key = [F.col(c) for c in by] or [F.lit(0)]
    ordered = Window.partitionBy(*key).orderBy("_ratio", *[c for c in df.columns if c not in by][:2])
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_ratio", ratio).withColumn("_total", total)
    rest = F.col("_total") - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    df = df.withColumn("_level", F.try_divide(rest, F.sum(weight).over(after))).withColumn("_place", F.row_number().over(ordered))
    ok = F.when(F.col("_level") <= F.col("_ratio") * (1 + 1e-12), F.struct("_place", "_level"))
    df = df.withColumn("_level", F.coalesce(F.min(ok).over(Window.partitionBy(*key))["_level"], F.max("_ratio").over(Window.partitionBy(*key))))
    return df.withColumn(out, F.least(F.col(most), F.col("_level") * F.col(weight))).drop("_ratio", "_total", "_level", "_place")


def _with_source(rows: DataFrame, of: DataFrame, other: str | None = None) -> DataFrame:
    """rows with what is known of their source (_s), or of the source and another column (_ and its first letter).

    Few sources are broadcast, so that no source's rows are dealt by it; with more of them, no source is all that hot.
    """
    of = materialise(of, "mixing-of-sources")
    same = F.col("source").eqNullSafe(F.col("_s"))
    if other:
        same &= F.col(other) == F.col(f"_{other[0]}")
    return rows.join(F.broadcast(of) if of.count() <= MOST_BROADCAST else of, same, "left").drop("_s")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source, source_size, target, copies, taken."""
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    # A row's random number depends on its content alone, so that reruns and lost executors give the same mix.
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")), 256), 1, 12), 16, 10).cast("double")
    sized = sized.withColumn("band", F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(F.lit(0)).cast("int")).withColumn("u", (drawn + 0.5) / F.lit(float(2**48)))
    sized = materialise(sized, "mixing-sizes")
    bands = sized.groupBy("source", "band").agg(F.sum("size").cast("double").alias("band_size"))
    sources = bands.groupBy("source").agg(F.sum("band_size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + F.lit(1.0)).withColumn("most", F.col("source_size") * MOST_COPIES)
    sources = _fill(sources, [], "weight", "most", F.sum("source_size").over(Window.partitionBy(F.lit(0))), "target").drop("weight", "most")
    bands = bands.withColumnRenamed("source", "_s").join(sources, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    bands = bands.withColumn("weight", F.col("band_size") * F.pow(F.lit(GENTLE), F.col("band"))).withColumn("most", F.col("band_size") * MOST_COPIES)
    bands = _fill(bands, ["source"], "weight", "most", F.col("target"), "band_target")
    rate = F.when(F.col("band_size") > 0, F.col("band_target") / F.col("band_size")).otherwise(F.lit(0.0))
    bands = bands.withColumn("rate", F.least(F.lit(float(MOST_COPIES)), rate)).withColumn("whole", F.floor("rate").cast("long")).withColumn("part", F.col("rate") - F.col("whole"))
    bands = bands.withColumn("rest", F.sum(F.col("band_size") * F.col("part")).over(Window.partitionBy("source")))
    bands = bands.select(F.col("source").alias("_s"), F.col("band").alias("_b"), F.col("source_size").cast("long").alias("source_size"), "target", "whole", "part", "rest")
    rows = _with_source(sized, bands, "band").drop("_b")
    # Pareto rank q / (1 + q) lies in 0 to 1 and orders as q does; a document without a part never enters the sample.
    q = F.try_divide(F.col("u") * (1 - F.col("part")), (1 - F.col("u")) * F.col("part"))
    rows = rows.withColumn("q", F.when((F.col("part") > 0) & (F.col("size") > 0), q / (1 + q)))
    rows = rows.withColumn("cell", F.least(F.floor(F.col("q") * CELLS), F.lit(CELLS - 1)).cast("int"))
    cells = rows.where("cell is not null").groupBy("source", "cell").agg(F.sum("size").alias("cell_size"), F.max("rest").alias("cell_rest"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("below", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    state = F.when(F.col("below") + F.col("cell_size") <= F.col("cell_rest"), 1).when(F.col("below") < F.col("cell_rest"), 0).otherwise(-1)
    cells = cells.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "below", state.alias("state"))
    rows = _with_source(rows, cells, "cell").drop("_c")
    rows = rows.withColumn("state", F.coalesce("state", F.lit(-1)))
    # In the cell of the cut, one a source, a document enters if it brings the sum nearer to what is wanted.
    inside = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("state = 0").withColumn("sum", F.col("below") + F.sum("size").over(inside))
    edge = edge.withColumn("enters", F.col("sum") - F.col("size") / 2 <= F.col("rest")).drop("sum")
    rows = edge.unionByName(rows.where("state <> 0").withColumn("enters", F.col("state") == 1))
    rows = materialise(rows.drop("cell", "state", "below"), "mixing-ranks")
    # One document a source enters or leaves late, where that brings the source nearer to its target.
    gaps = rows.groupBy(F.col("source").alias("_s")).agg((F.max("rest") - F.sum(F.when(F.col("enters"), F.col("size")).otherwise(0))).alias("gap"))
    rows = _with_source(rows, gaps)
    left = F.abs(F.col("gap") - F.when(F.col("enters"), -F.col("size")).otherwise(F.col("size")))
    late = F.when(F.col("q").isNotNull() & (left < F.abs("gap")), F.struct(left.alias("left"), "q", "doc_id", "size"))
    best = rows.groupBy(F.col("source").alias("_s")).agg(F.min(late).alias("best"))
    rows = _with_source(rows, best)
    is_best = F.coalesce((F.col("q") == F.col("best.q")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("size") == F.col("best.size")), F.lit(False))
    copies = F.col("whole") + F.when(F.col("enters") != is_best, 1).otherwise(0)
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
