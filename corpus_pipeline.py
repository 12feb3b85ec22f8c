"""The corpus pipeline: toxic texts go, texts of low quality go, one of near copies stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.llm import neardup, packing, quality, toxicity
from kindling.llm.common import Scratch, checked_broadcast, documents_of, table

#: Near copies are judged here on runs of five words.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't predicted toxic; the model learns from the labels of ``docs``' own rows."""
    model = toxicity.fit(documents_of(docs), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier, trained on ``docs``, keeps."""
    return quality.scored_rows(docs, quality.fit(docs)).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row of the smallest id; rows without an id come after all others.

    Rows have keys of their own here, so repeated rows are copies of each other, and texts that
    share an id are judged each.
    """
    scratch, key = Scratch(spark, "near-copies"), "_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    keyed = scratch.write(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    ids = keyed.select(F.col(key).alias("_key"), F.col("doc_id").alias("_id"))
    linked = neardup.near_duplicates(keyed, id_col=key, shingle=SHINGLE, percent=PERCENT).select(F.col("doc_id").alias("_key"), "component_id")
    alone = F.col("component_id") == F.col("_key")
    linked = scratch.write(linked.withColumn("alone", alone), "linked")
    groups = linked.where("not alone").select("component_id").distinct()  # groups of two and more
    of_groups = linked.join(groups, "component_id", "left_semi").join(ids, "_key")
    of_groups = scratch.write(of_groups.select("_key", "component_id", F.struct(F.col("_id").isNull(), "_id", "_key").alias("place")), "groups")
    first = of_groups.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first._key").alias("_key"))
    rejected = scratch.write(of_groups.select("_key").join(first, "_key", "left_anti"), "rejected")
    rejected = checked_broadcast(rejected.select(F.col("_key").alias(key)), rejected.count(), 16)
    return keyed.join(rejected, key, "left_anti").drop(key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, in sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_dedup", drop_near_copies), ("packing", pack)]

#: SQL can't express the models; tests hold each stage against its operator's brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = out
    return docs
