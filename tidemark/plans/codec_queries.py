"""Whole memories written as plain columns and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.text import memory_type
from tidemark.plans.memory_queries import TYPED_SQL
from tidemark.plans.registry import query
from tidemark.sources.tables import load


def whole_memories(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as memories with all their lists (`codec.MEMORY`)."""
    docs = load(spark, sf, "documents")
    number = F.col("doc_id")
    words = F.slice(F.regexp_extract_all(F.lower(F.left("text", F.lit(80))), F.lit("([a-z]{6,})"), F.lit(1)), 1, 3)
    at = lambda minutes: F.timestamp_seconds(1704067200 + number * 60 + minutes * 60)
    entity = lambda w: F.struct(F.md5(w.cast("binary")).alias("entity_id"), w.alias("label"), F.lit("concept").alias("entity_type"), F.array(F.upper(w)).alias("aliases"), F.lit("").alias("description"))
    anchor = F.struct(
        number.cast("string").alias("anchor_id"), F.when(number % 2 == 0, at(-1440)).alias("event_at"), at(0).alias("recorded_at"), F.lit(None).cast("string").alias("relative_expression"), F.lit("hour").alias("precision")
    )
    belief = F.struct(
        number.cast("string").alias("belief_id"), F.left("text", F.lit(20)).alias("content"), F.lit("tentative").alias("confidence"), F.col("source").alias("source"), at(0).alias("adopted_at"),
        F.when(number % 4 == 0, (number + 1).cast("string")).alias("superseded_by"), F.when(number % 4 == 0, at(5)).alias("superseded_at"),
    )
    return docs.select(
        number.alias("entry_id"), F.lit("impression").alias("tier"), F.left("text", F.lit(80)).alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.lit("tenant").alias("scope_type"),
        F.col("source").alias("scope_id"), F.when(number % 3 == 0, number - 1).alias("parent_id"), F.lit("").alias("state_key"), F.lit("day").alias("temporal_precision"), ((number % 101) / 100.0).alias("decay"),
        (number % 20).alias("hits"), F.array("lang", "source").alias("tags"), F.array(number.cast("string")).alias("related_ids"), F.transform(words, entity).alias("entities"), F.array(anchor).alias("anchors"),
        F.array(belief).alias("beliefs"), at(0).alias("created_at"), at(30).alias("touched_at"), F.when(number % 5 == 0, at(-60)).alias("event_start"), F.lit(None).cast("timestamp").alias("event_end"),
        memory_type(F.col("text")).alias("memory_type"), (number % 2 == 0).alias("is_active"),
    )


@query(f"""{TYPED_SQL}, wo AS (SELECT doc_id, lang, source, regexp_extract_all(lower(left(text, 80)), '[a-z]{{6,}}')[1:3] AS w FROM documents),
ro AS (SELECT doc_id, to_json([lang, source]) AS tags_json, to_json([{{'entity_id': md5(x), 'label': x, 'entity_type': 'concept', 'aliases': [upper(x)], 'description': ''}} FOR x IN w])::VARCHAR AS entities_json FROM wo)
SELECT doc_id AS entry_id, tags_json::VARCHAR AS tags_json, entities_json, memory_type, strftime(make_timestamp((1704067200 + doc_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, true AS same,
 CASE WHEN doc_id % 7 = 3 AND entities_json <> '[]' THEN 1 ELSE 0 END AS n_bad FROM ro JOIN ty ON entry_id = doc_id""")
def s05_row_codec(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of a memory there and back are the same; a row whose list of entities is cut short is counted, not lost."""
    rows = whole_memories(spark, sf)
    rest = [c for c in rows.columns if c != "entities"]
    signs = lambda when: (F.xxhash64(F.to_json(F.struct(*rest))).alias(f"rest_{when}"), F.xxhash64(F.to_json("entities")).alias(f"entities_{when}"))
    written = codec.encode(rows.select("*", *signs("was")), "rest_was", "entities_was")
    told = written.withColumns({"written_at": F.col("created_at"), "list": F.col("entities_json")})
    damaged = told.withColumn("entities_json", F.when(F.col("entry_id") % 7 == 3, F.left("entities_json", F.lit(5))).otherwise(F.col("entities_json")))
    back = codec.decode(damaged, "rest_was", "entities_was", "tags_json", "written_at", "list").select("*", *signs("now"))
    same = (F.col("rest_was") == F.col("rest_now")) & ((F.col("n_bad") > 0) | F.col("entities_was").eqNullSafe(F.col("entities_now")))
    return back.select("entry_id", "tags_json", F.col("list").alias("entities_json"), "memory_type", F.col("written_at").alias("created_at"), same.alias("same"), "n_bad")
