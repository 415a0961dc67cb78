"""A corpus from documents: toxic ones go, one of each near-duplicate group stays, repeated passages are cut, sources are
mixed to target weights, and the mix is packed into sequences. Each stage works on all that the one before has kept.

A row without a doc_id is a document of its own, and so are rows that share one with different texts. Of rows that are near
duplicates the one of the least doc_id stays, one without an id only where none has one; so one stays of rows that are alike
in id and text. Rows whose text is null or has no words are linked with nothing and stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.llm import mixing, packing, setjoin, suffix_dedup, toxicity
from voltspan.llm._io import materialise, table

#: Near duplicates share 0.8 of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _row: the doc_id where just one row has it, else a hash of id and text."""
    repeated = materialise(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n")).where("_n > 1").select("_d"), "pipeline-repeated-ids")
    odd = F.col("doc_id").isNull() | F.col("_d").isNotNull()
    return docs.join(repeated, F.col("doc_id") == F.col("_d"), "left").withColumn("_row", F.when(odd, F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))).drop("_d")


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    linked = setjoin.link(rows.select(F.col("_row").alias("doc_id"), "text"), SHINGLE, PERCENT)
    sets = linked.groupBy(F.col("doc_id").alias("_row"), "component_id").agg(((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("_again"))
    members = sets.join(rows.select("_row", "doc_id").distinct(), "_row")
    heads = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "_again")).alias("h")).select("h._row", "h._again")
    kept = rows.join(materialise(heads, "pipeline-heads"), "_row")
    # Of rows that are alike in id and text, the least stays.
    one = kept.where("_again").groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("_least")).select("_least.*")
    return kept.where("not _again").select(*docs.columns).unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs).withColumns({"_given": F.col("doc_id"), "doc_id": F.col("_row")}).drop("_row")
    kept = suffix_dedup.removed_text(rows)
    return kept.withColumns({"doc_id": F.col("_given"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    mixed = mixing.mix(rows.select(F.col("_row").alias("doc_id"), "text", "source"))
    copies = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.max("copies").cast("int").alias("copies"))
    return rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [("toxicity", clean), ("n-gram Jaccard join", join_near), ("suffix-array dedup", cut_repeats), ("mixing", mix), ("best-fit packing", pack)]
#: SQL has no tokenizer and no learnt model; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
