"""The memory model as views over the given tables. Nothing is read before it is used; columns are pruned by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("impression", "pattern", "principle")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: tier by id, scope by source, times in epoch seconds."""
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entry_id"),
        F.expr("CASE doc_id % 10 WHEN 0 THEN 'principle' WHEN 1 THEN 'pattern' WHEN 2 THEN 'pattern' ELSE 'impression' END").alias("tier"),
        F.expr("left(text, 80)").alias("title"), F.col("text").alias("content"), F.col("source").alias("scope_id"), F.col("lang").alias("tag"),
        F.expr("(doc_id % 101) / 100.0D").alias("decay"), (F.col("doc_id") % 20).alias("hits"),
        F.expr("1704067200 + doc_id * 60").alias("created_at"), F.expr("1704067200 + doc_id * 60 + (doc_id % 7 - 1) * 1800").alias("touched_at"),
    )


MEMORIES_SQL = """mem AS (SELECT doc_id AS entry_id, CASE doc_id % 10 WHEN 0 THEN 'principle' WHEN 1 THEN 'pattern' WHEN 2 THEN 'pattern' ELSE 'impression' END AS tier,
 left(text, 80) AS title, text AS content, source AS scope_id, lang AS tag, (doc_id % 101) / 100.0 AS decay, doc_id % 20 AS hits,
 1704067200 + doc_id * 60 AS created_at, 1704067200 + doc_id * 60 + (doc_id % 7 - 1) * 1800 AS touched_at FROM documents)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as the history of memories."""
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("memory_id"),
        F.expr("CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'touched' WHEN 'click' THEN 'revised' WHEN 'purchase' THEN 'promoted' ELSE 'healed' END").alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EVENTS_SQL = """ev AS (SELECT event_id, user_id AS memory_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'touched' WHEN 'click' THEN 'revised'
 WHEN 'purchase' THEN 'promoted' ELSE 'healed' END AS kind, epoch_us(ts) AS "at", value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
