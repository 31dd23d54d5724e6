"""The thin queries of the ten operators: whole tables in, the contracts' columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import audio_fingerprints, context_mixing, factor_quality, personal_data
from tidemark.llm.best_fit_packing import pack
from tidemark.llm.blocked_search import search
from tidemark.llm.chat_format import digests, format_conversations, with_probe
from tidemark.llm.common import fold, table
from tidemark.llm.compression_bands import with_compression_verdict
from tidemark.llm.filter_audit import audit
from tidemark.llm.minimax_shards import minimax_shards
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.pareto_mix import pareto_mix
from tidemark.llm.oracles import FILTER_AUDIT, LEXICAL_SEARCH
from tidemark.llm.stock_packing import stock_pack


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = factor_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = factor_quality.with_quality(docs, machine)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.find_personal_data(table(spark, sf_dir, "documents")))


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_conversations(with_probe(table(spark, sf_dir, "conversations"))))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_compression_verdict(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "verdict.*")


def op9_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media column: the embeddings played as melodies; queries are the rows whose id 50 divides, against all rows. One row a vector, with its class and its links."""
    return audio_fingerprints.link_vectors(table(spark, sf_dir, "embeddings"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.context_mixing_scores(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_factor_quality": op2_factor_quality,
    "op3_pareto_mixing": op3_pareto_mixing,
    "op4_personal_data": op4_personal_data,
    "op5_minimax_sharding": op5_minimax_sharding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_compression_bands": op8_compression_bands,
    "op9_audio_fingerprints": op9_audio_fingerprints,
    "op10_context_mixing": op10_context_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_blocked_search": op12_blocked_search,
    "op13_stock_packing": op13_stock_packing,
}

#: The others cannot be said whole in SQL (sketches, compressors, tokenizers, learned weights, hashes of Spark); tests hold them to brute force.
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": FILTER_AUDIT, "op12_blocked_search": LEXICAL_SEARCH}
