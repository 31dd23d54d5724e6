"""A training corpus from raw documents: quality rules, near-dedup, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.best_fit_packing import pack
from tidemark.llm.common import boxed, ready, remove, table, unboxed
from tidemark.llm.compression_bands import with_compression_verdict
from tidemark.llm.near_dedup import one_of_each
from tidemark.llm.pareto_mix import mix_rows
from tidemark.llm.personal_data import redact
from tidemark.llm.queries import tokenizer_path

#: Near copies share 80 % of their five-word shingles.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go.

    Null and empty texts have no words and so go; repeated rows share their fate. Any further columns stay as they are, whatever their names.
    """
    rows = boxed(docs, F.col("text").cast("string").alias("text"))
    return unboxed(with_compression_verdict(rows).where("verdict.kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays, that of the smallest id; of repeated rows one stays too.

    Ids come before nulls; among rows with one id a hash of the whole row decides. Rows without words are in no class and stay.
    """
    return one_of_each(docs, NEAR_PERCENT)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every row stays. Null texts stay null."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target words. Texts without words are never taken."""
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null text is its end alone."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Compressors, sketches and tokenizers cannot be said in SQL; the tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared checkpoint folder and read again.

    A stage's files go when the next one is written; only those of the last written stage stay, as the result reads them.
    """
    ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if k:
                remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
