"""Tiers condensed in runs, each impression once: what is made and what it rests on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.condensation import LINKS, PATTERN_TEXT, PATTERN_TITLE, PATTERNS, PRINCIPLE_TEXT, PRINCIPLE_TITLE, PRINCIPLES, condense_tiers
from tidemark.operators.lineage import shared_folder
from tidemark.plans.memory_queries import _BELIEF_SQL, _beliefs, _entities
from tidemark.plans.registry import query
from tidemark.sources.tables import MEMORIES_SQL, memories
from tidemark.streaming.batch_store import BatchStore

KINDS = ("created", "touched", "revised", "promoted", "healed")

_TIERS_SQL = f"""{_BELIEF_SQL}, {MEMORIES_SQL},
half AS (SELECT (min(created_at) + max(created_at)) // 2 AS middle FROM mem),
ent AS (SELECT entry_id, coalesce(scope_id, '') AS scope_id, tier, created_at, coalesce(tag, '') AS kind, left(content, 200) AS head,
 [x FOR x IN [tag, CASE WHEN hits >= 10 THEN 'often' ELSE 'seldom' END] IF x IS NOT NULL] AS tags, CASE WHEN created_at <= middle THEN 1 ELSE 2 END AS half,
 list_distinct(regexp_extract_all(lower(title), '[a-z]{{6,}}')) AS labels FROM mem, half),
sure AS (SELECT 5 * memory_id + list_position({list(KINDS)!r}, content) - 1 AS entry_id, belief_id, content AS belief FROM bl WHERE superseded_at IS NULL AND confidence >= 0.5),
imp AS (SELECT * EXCLUDE (labels), unnest(labels) AS label FROM ent WHERE tier = 'impression'),
cnt AS (SELECT *, count(*) FILTER (half = 1) OVER c AS n1, count(*) OVER c AS n FROM imp WINDOW c AS (PARTITION BY scope_id, kind, label)),
ran AS (SELECT *, CASE WHEN n1 >= 5 AND half = 1 THEN 1 WHEN n1 >= 5 AND n - n1 >= 5 THEN 2 WHEN n1 < 5 AND n >= 5 THEN 2 END AS run FROM cnt),
held AS (SELECT *, left(md5(concat_ws(chr(31), scope_id, kind, label, run)), 16) AS made_id FROM ran WHERE run IS NOT NULL),
tagged AS (SELECT made_id, list(tag ORDER BY times DESC, tag)[1:5] AS tags FROM (SELECT made_id, tag, count(*) AS times FROM (SELECT made_id, unnest(tags) AS tag FROM held) GROUP BY ALL) GROUP BY made_id),
said AS (SELECT made_id, count(*) AS n_beliefs FROM held JOIN sure USING (entry_id) GROUP BY made_id),
pat AS (SELECT made_id, scope_id, kind, label, run, count(*) AS n_sources, coalesce(arg_max(coalesce(head, ''), (created_at, entry_id)), '') AS head, any_value(tags.tags) AS tags, coalesce(any_value(n_beliefs), 0) AS n_beliefs
 FROM held h JOIN tagged tags USING (made_id) LEFT JOIN said USING (made_id) GROUP BY ALL),
cand AS (SELECT made_id AS source_id, scope_id, run AS half, tags, [label] AS labels FROM pat WHERE n_beliefs > 0
 UNION ALL SELECT CAST(entry_id AS VARCHAR), scope_id, half, tags, labels FROM ent WHERE tier = 'pattern' AND entry_id IN (SELECT entry_id FROM sure)),
ccnt AS (SELECT *, count(*) FILTER (half = 1) OVER c AS n1, count(*) OVER c AS n FROM cand WINDOW c AS (PARTITION BY scope_id)),
cran AS (SELECT *, CASE WHEN n1 >= 3 AND half = 1 THEN 1 WHEN n1 >= 3 AND n - n1 >= 3 THEN 2 WHEN n1 < 3 AND n >= 3 THEN 2 END AS run FROM ccnt),
cheld AS (SELECT *, left(md5(concat_ws(chr(31), 'principle', scope_id, run)), 16) AS made_id FROM cran WHERE run IS NOT NULL),
ctag AS (SELECT made_id, list(tag ORDER BY times DESC, tag)[1:3] AS tags FROM (SELECT made_id, tag, count(*) AS times FROM (SELECT made_id, unnest(tags) AS tag FROM cheld) GROUP BY ALL) GROUP BY made_id),
clab AS (SELECT made_id, list(DISTINCT label ORDER BY label)[1:10] AS labels FROM (SELECT made_id, unnest(labels) AS label FROM cheld) GROUP BY made_id)"""


def _text(form: str, *values: str) -> str:
    """The SQL of a fixed text with its places filled."""
    pieces = form.replace("%d", "%s").split("%s")
    quoted = [f"replace('{p}', '\\n', chr(10))".replace("\n", "\\n") for p in pieces]
    return " || ".join(x for pair in zip(quoted, [*values, "''"], strict=True) for x in pair)


_PATTERN_TEXT_SQL = _text(PATTERN_TEXT, "n_sources", "label", "array_to_string(tags, ', ')", "n_beliefs", "head")
_PRINCIPLE_TEXT_SQL = _text(PRINCIPLE_TEXT, "count(*)", "array_to_string(coalesce(any_value(l.labels), []), ', ')", "array_to_string(any_value(t.tags), ', ')")


def _runs(spark: SparkSession, sf: str) -> BatchStore:
    """Two runs: over the memories of the first half of the time, then over all of them. A user's beliefs lie on five memories, one a kind."""
    rows = memories(spark, sf).withColumn("tags", F.array_compact(F.array("tag", F.when(F.col("hits") >= 10, "often").otherwise("seldom"))))
    labels = _entities(spark, sf).select("entry_id", F.col("tag").alias("kind"), "label")
    place = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("content")) - 1
    level = F.when(F.col("confidence") >= 0.75, "bedrock").when(F.col("confidence") >= 0.5, "confirmed").otherwise("tentative")
    held = _beliefs(spark, sf).where("superseded_at IS NULL").select((5 * F.col("memory_id") + place).alias("entry_id"), "belief_id", "content", level.alias("confidence"))
    first = rows.join(F.broadcast(rows.agg(F.expr("(min(created_at) + max(created_at)) div 2").alias("middle"))), F.col("created_at") <= F.col("middle")).drop("middle")
    store = BatchStore(spark, f"{shared_folder(spark)}/tiers-{uuid.uuid4().hex}")
    for run, some in enumerate((first, rows), 1):
        store.write(run, condense_tiers(some, labels, held, store.read("patterns", PATTERNS), store.read("links", LINKS), run))
    return store


@query(f"""{_TIERS_SQL}
SELECT 'pattern' AS tier, made_id, run, scope_id, {_text(PATTERN_TITLE, "label")} AS title, {_PATTERN_TEXT_SQL} AS content, n_sources FROM pat
UNION ALL SELECT 'principle', made_id, run, scope_id, {_text(PRINCIPLE_TITLE, "count(*)")}, {_PRINCIPLE_TEXT_SQL}, count(*) FROM cheld JOIN ctag t USING (made_id) LEFT JOIN clab l USING (made_id) GROUP BY made_id, run, scope_id""")
def d03_condensed_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The patterns and principles of two runs."""
    store, shown = _runs(spark, sf), ("made_id", "run", "scope_id", "title", "content", "n_sources")
    made = [store.read(name, schema).select(F.lit(tier).alias("tier"), *shown) for tier, name, schema in (("pattern", "patterns", PATTERNS), ("principle", "principles", PRINCIPLES))]
    return made[0].unionByName(made[1])


@query(f"{_TIERS_SQL} SELECT made_id, CAST(entry_id AS VARCHAR) AS source_id FROM held UNION ALL SELECT made_id, source_id FROM cheld")
def d03_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What each pattern and principle rests on; no impression is twice in one cluster, no pattern under two principles."""
    return _runs(spark, sf).read("links", LINKS).select("made_id", "source_id")
