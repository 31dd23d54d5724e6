"""Histories with merges and splits, rollbacks and shortest paths, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import event_graph, graphs
from tidemark.plans.history_queries import _links
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, events

#: Promotions merge two other memories into theirs, every second healing gives off one.
_HISTORY_SQL = f"""WITH {EVENTS_SQL}, hi AS (SELECT event_id, memory_id, "at", k, CASE WHEN kind = 'promoted' THEN 'merged' WHEN kind = 'healed' AND k % 2 = 0 THEN 'split' ELSE kind END AS kind FROM ev),
li AS (SELECT event_id, "at", kind, memory_id + 1 AS other FROM hi WHERE kind IN ('merged', 'split') UNION SELECT event_id, "at", kind, memory_id + 2 + k % 5 FROM hi WHERE kind = 'merged')"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("kind") == "promoted", "merged").when((F.col("kind") == "healed") & (F.col("k") % 2 == 0), "split").otherwise(F.col("kind"))
    return events(spark, sf).select("event_id", "memory_id", "at", "k", kind.alias("kind"))


@query(f"""{_HISTORY_SQL} SELECT from_event, event_id AS to_event, 'evolves_to' AS relation FROM (SELECT *, lag(event_id) OVER (PARTITION BY memory_id ORDER BY "at", event_id) AS from_event FROM hi) WHERE from_event IS NOT NULL AND kind <> 'created'
UNION ALL SELECT arg_max(h.event_id, (h."at", h.event_id)), l.event_id, 'merges_into' FROM li l JOIN hi h ON h.memory_id = l.other AND (h."at" < l."at" OR (h."at" = l."at" AND h.event_id < l.event_id)) WHERE l.kind = 'merged' GROUP BY l.event_id, l.other
UNION ALL SELECT l.event_id, arg_min(h.event_id, (h."at", h.event_id)), 'splits_from' FROM li l JOIN hi h ON h.memory_id = l.other AND (h."at" > l."at" OR (h."at" = l."at" AND h.event_id > l.event_id)) WHERE l.kind = 'split' GROUP BY l.event_id, l.other""")
def l01_history_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All edges of all histories: evolutions, what a merge took in, what a split gave off."""
    rows = _history(spark, sf)
    first, second = F.col("memory_id") + 1, F.col("memory_id") + 2 + F.col("k") % 5
    others = F.when(F.col("kind") == "merged", F.array(first, second)).when(F.col("kind") == "split", F.array(first))
    return event_graph.history_edges(rows, rows.select("event_id", F.explode(others).alias("other_memory")))


#: Changes of a counter of 90 or more ask for a rollback: to the memory's event before, to the event before of any memory, or to one that is not there.
_ROLLBACK_SQL = f"""WITH {EVENTS_SQL}, sn AS (SELECT *, lag(event_id) OVER (PARTITION BY memory_id ORDER BY "at", event_id) AS prior FROM ev),
re AS (SELECT event_id AS request_id, memory_id, "at", CASE WHEN k % 4 < 2 THEN prior WHEN k % 4 = 2 THEN event_id - 1 ELSE -1 END AS target_event FROM sn WHERE k >= 90),
ju AS (SELECT re.*, CASE WHEN s.event_id IS NULL THEN 'missing event' WHEN s.memory_id <> re.memory_id THEN 'other memory' WHEN s.kind = 'touched' THEN 'empty snapshot' ELSE 'restored' END AS outcome,
 s.kind AS title, CASE WHEN s.kind IN ('revised', 'promoted') THEN s.value END AS content FROM re LEFT JOIN sn s ON s.event_id = re.target_event),
st AS (SELECT *, last_value(CASE WHEN outcome = 'restored' THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN outcome = 'restored' THEN content END IGNORE NULLS) OVER w AS c1 FROM ju
 WINDOW w AS (PARTITION BY memory_id ORDER BY "at", request_id ROWS UNBOUNDED PRECEDING)),
bo AS (SELECT *, lag(t1) OVER w AS t0, lag(c1) OVER w AS c0 FROM st WINDOW w AS (PARTITION BY memory_id ORDER BY "at", request_id)), e AS (SELECT memory_id, max(value) AS content FROM ev GROUP BY memory_id)"""


def _rollbacks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf)
    full = F.create_map(F.lit("title"), "kind", F.lit("content"), F.col("value").cast("string"))
    snapshot = F.when(F.col("kind").isin("revised", "promoted"), full).when(F.col("kind") != "touched", F.create_map(F.lit("title"), "kind"))
    prior = F.lag("event_id").over(Window.partitionBy("memory_id").orderBy("at", "event_id"))
    target = F.when(F.col("k") % 4 < 2, F.col("prior")).when(F.col("k") % 4 == 2, F.col("event_id") - 1).otherwise(-1)
    requests = rows.withColumn("prior", prior).where("k >= 90").select(F.col("event_id").alias("request_id"), "memory_id", "at", target.alias("target_event"))
    entries = rows.groupBy("memory_id").agg(F.lit("as it is").alias("title"), F.max("value").cast("string").alias("content"))
    return entries, event_graph.rollback(rows.select("event_id", "memory_id", snapshot.alias("snapshot")), entries, requests)


@query(f"""{_ROLLBACK_SQL} SELECT request_id, target_event, outcome, CASE WHEN outcome = 'restored' THEN coalesce(t0, 'as it is') END AS before_title, CASE WHEN outcome = 'restored' THEN t1 END AS after_title,
 CASE WHEN outcome = 'restored' THEN coalesce(c0, e.content) END AS before_content, CASE WHEN outcome = 'restored' THEN coalesce(c1, e.content) END AS after_content FROM bo JOIN e USING (memory_id)""")
def l04_rollback_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every request for a rollback with its guard, and the rolled-back event where it was carried out."""
    _, done = _rollbacks(spark, sf)
    number = lambda c: F.col(c).cast("double").alias(c)
    return done.select("request_id", "target_event", "outcome", "before_title", "after_title", number("before_content"), number("after_content"))


@query(f"""{_ROLLBACK_SQL}, la AS (SELECT memory_id, arg_max(t1, ("at", request_id)) AS t, arg_max(c1, ("at", request_id)) AS c FROM st GROUP BY memory_id)
SELECT memory_id, coalesce(t, 'as it is') AS title, coalesce(c, content) AS content FROM e LEFT JOIN la USING (memory_id)""")
def l04_entries_after_rollback(spark: SparkSession, sf: str) -> DataFrame:
    entries, done = _rollbacks(spark, sf)
    return event_graph.restored_entries(entries, done).select("memory_id", "title", F.col("content").cast("double").alias("content"))


@query()
def g09_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of a shortest path, up to six steps, from the smallest memory to every node that 50 divides; tests hold it to a breadth-first walk over the same table."""
    links = _links(spark, sf)
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    return graphs.paths(links, links.agg(F.min("a").alias("node")), nodes.where("node % 50 = 0"))
