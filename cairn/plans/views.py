"""The driver's tables seen as records, relations and queries; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def memories(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    d, y = table(spark, sf, "documents") if documents is None else documents, table(spark, sf, "labels")
    kind = F.when(F.col("lang") == "fr", "decision").when(F.col("lang") == "de", "hypothesis").when(F.col("lang") == "es", "checkpoint").otherwise("fact")
    status = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "obsolete").otherwise("registered")
    decision = F.when(F.col("lang") == "fr", F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "superseded"))
    return d.join(y, "doc_id", "left").select(
        F.col("doc_id").alias("id"), kind.alias("type"), F.col("source").alias("project_id"), F.col("text").alias("content"), status.alias("status"), decision.alias("decision_status"),
        F.col("doc_id").alias("created_at"), F.lit(None).cast("long").alias("supersedes"), F.lit(None).cast("long").alias("superseded_by"),
    )


def texts(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    """(id, content) of ``memories`` as they are read, without the join of labels: what reads texts shuffles none."""
    d = table(spark, sf, "documents") if documents is None else documents
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def relations(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    """Each document with the text of an earlier one is similar to the first that has it."""
    d = (table(spark, sf, "documents") if documents is None else documents).select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("target_id"))
    return d.join(first, "h").where("doc_id <> target_id").select(F.col("doc_id").alias("source_id"), "target_id", F.lit("similar_to").alias("relation_type"), F.col("doc_id").alias("rank"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("project_id"))


MEMORIES = """memories AS (SELECT doc_id AS id, CASE lang WHEN 'fr' THEN 'decision' WHEN 'de' THEN 'hypothesis' WHEN 'es' THEN 'checkpoint' ELSE 'fact' END AS type, source AS project_id, text AS content,
 CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'obsolete' ELSE 'registered' END AS status,
 CASE WHEN lang = 'fr' THEN CASE quality WHEN 1 THEN 'active' WHEN 0 THEN 'superseded' END END AS decision_status, doc_id AS created_at FROM documents LEFT JOIN labels USING (doc_id))"""
RELATIONS = """relations AS (SELECT doc_id AS source_id, min(doc_id) OVER (PARTITION BY text) AS target_id, 'similar_to' AS relation_type, doc_id AS rank FROM documents QUALIFY source_id <> target_id)"""
DEGREES = """degrees AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY id)"""
