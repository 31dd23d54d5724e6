"""Collects the registered queries of all modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import retrieval
from tidemark.plans import codec_queries, condensation_queries, event_queries, extraction_queries, graph_queries, history_queries, log_queries, memory_queries, question_queries, registry, replica_queries, search_queries, store_queries, stream_queries  # noqa: F401  they register
from tidemark.sources.tables import memories


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recall(memories(spark, sf_dir), graph_queries.QUERY)
