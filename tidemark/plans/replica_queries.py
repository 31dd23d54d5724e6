"""Replicas merged field by field, and a second replica's log applied, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import replicas
from tidemark.operators.lineage import shared_folder
from tidemark.plans.registry import query
from tidemark.sources.tables import EVENTS_SQL, events

DAY = 86_400_000_000
#: Two nodes change the kinds of a memory and tell each other of it two days later.
LAG = 2 * DAY

_LOG_SQL = f"""WITH {EVENTS_SQL}, lg AS (SELECT memory_id, kind AS field, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS node, event_id, "at", k,
 row_number() OVER (PARTITION BY memory_id, kind, event_id % 2 ORDER BY "at", event_id) AS tick,
 count(*) FILTER (event_id % 2 = 0) OVER (PARTITION BY memory_id, kind ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND {LAG} PRECEDING) AS a_known,
 count(*) FILTER (event_id % 2 = 1) OVER (PARTITION BY memory_id, kind ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND {LAG} PRECEDING) AS b_known FROM ev)"""


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of fields; a change's clock is what its node had heard of the other one by then."""
    node = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    field = Window.partitionBy("memory_id", "kind")
    heard = field.orderBy("at").rangeBetween(Window.unboundedPreceding, -LAG)
    tick = F.row_number().over(Window.partitionBy("memory_id", "kind", node).orderBy("at", "event_id")).cast("long")
    clock = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(*(F.count_if(node == n).over(heard) for n in "ab")))
    rows = events(spark, sf).select("memory_id", "event_id", "k", "kind", "at", node.alias("node"), tick.alias("tick"), clock.alias("heard"))
    return rows.select(
        "memory_id", F.col("kind").alias("field"), "node", "tick", "at", F.col("event_id").cast("string").alias("value"),
        F.transform_values("heard", lambda n, x: F.when(n == F.col("node"), F.col("tick")).otherwise(x)).alias("clock"), "k",
    )


@query(f"""{_LOG_SQL}, la AS (SELECT memory_id, field, node, max(tick) AS tick, arg_max(event_id, tick) AS event_id, arg_max("at", tick) AS "at", max(CASE node WHEN 'a' THEN b_known ELSE a_known END) AS other_known
 FROM lg GROUP BY memory_id, field, node),
su AS (SELECT * FROM la v WHERE NOT EXISTS (SELECT 1 FROM la w WHERE w.memory_id = v.memory_id AND w.field = v.field AND w.node <> v.node AND w.other_known >= v.tick))
SELECT memory_id, field, CAST(row_number() OVER (PARTITION BY memory_id, field ORDER BY "at" DESC, node DESC) AS INTEGER) AS place, CAST(event_id AS VARCHAR) AS value, node, "at", count(*) OVER (PARTITION BY memory_id, field) > 1 AS conflict FROM su""")
def y05_field_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two replicas that each hold a part of the log, merged field by field; concurrent values are kept as conflict rows."""
    log = change_log(spark, sf)
    local, remote = replicas.snapshot_of(log.where("k < 70")), replicas.snapshot_of(log.where("k >= 30"))
    return replicas.field_rows(replicas.merge_snapshots(local, remote))


#: The first day's events are entries; later ones are changes by three nodes, some of them handed over already.
_SYNC_SQL = f"""WITH {EVENTS_SQL}, en AS (SELECT memory_id, max("at") + {DAY} AS touched_at, max_by(kind, ("at", event_id)) AS title FROM ev WHERE k < 40 GROUP BY memory_id HAVING memory_id % 3 <> 0),
ch AS (SELECT event_id AS sync_id, memory_id, CASE kind WHEN 'created' THEN 'create' WHEN 'healed' THEN 'delete' WHEN 'promoted' THEN 'move' ELSE 'update' END AS operation, kind, k, "at",
 ['x', 'y', 'z'][event_id % 3 + 1] AS node, k AS cx, event_id % 100 AS cy, CASE WHEN k % 5 = 0 THEN 'done' ELSE 'pending' END AS status FROM ev),
ju AS (SELECT c.*, CASE WHEN operation = 'move' OR EXISTS (SELECT 1 FROM ch p WHERE p.memory_id = c.memory_id AND p.node = 'x' AND p.k > 90 AND p.status = 'pending' AND ((p.cx > c.cx AND p.cy < c.cy) OR (p.cx < c.cx AND p.cy > c.cy))) THEN 'conflict'
 WHEN c."at" <= (SELECT touched_at FROM en WHERE en.memory_id = c.memory_id) THEN 'skip' ELSE 'apply' END AS decision FROM ch c WHERE node <> 'x' AND status = 'pending')"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where("k < 40").groupBy("memory_id").agg((F.max("at") + DAY).alias("touched_at"), F.max_by("kind", F.struct("at", "event_id")).alias("title"))
    return rows.where("memory_id % 3 <> 0").select("memory_id", F.create_map(F.lit("title"), "title").alias("fields"), F.lit(True).alias("is_active"), "touched_at")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    operation = F.when(F.col("kind") == "created", "create").when(F.col("kind") == "healed", "delete").when(F.col("kind") == "promoted", "move").otherwise("update")
    clock = F.create_map(F.lit("x"), F.col("k").cast("long"), F.lit("y"), F.col("event_id") % 100)
    return events(spark, sf).select(
        F.col("event_id").alias("sync_id"), "memory_id", operation.alias("operation"), F.create_map(F.col("kind"), F.col("event_id").cast("string")).alias("payload"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("event_id") % 3 + 1).cast("int")).alias("node"), clock.alias("clock"), "at",
        F.when(F.col("k") % 5 == 0, replicas.DONE).otherwise(replicas.PENDING).alias("status"),
    )


def _pulled(spark: SparkSession, sf: str) -> DataFrame:
    """The log of a second replica, written to a folder of its own and read from there, judged against what is here."""
    there = f"{shared_folder(spark)}/replica-{uuid.uuid4().hex}"
    log = _changes(spark, sf)
    log.write.parquet(there)
    mine = log.where("clock['x'] > 90")
    return replicas.judge(replicas.open_log(spark, there, "x"), _entries(spark, sf), mine, "x")


@query(f"{_SYNC_SQL} SELECT node, operation, decision, count(*) AS n FROM ju GROUP BY ALL")
def s20_pull_replica(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of a second replica's changes."""
    return _pulled(spark, sf).groupBy("node", "operation", "decision").agg(F.count("*").alias("n"))


@query(f"""{_SYNC_SQL}, ap AS (SELECT * FROM ju WHERE decision = 'apply'),
fi AS (SELECT memory_id, kind AS field, CAST(max_by(sync_id, ("at", sync_id)) AS VARCHAR) AS value FROM ap WHERE operation <> 'delete' GROUP BY memory_id, kind),
al AS (SELECT memory_id, 'title' AS field, title AS value FROM en UNION ALL SELECT * FROM fi),
ma AS (SELECT memory_id, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM al GROUP BY memory_id),
ed AS (SELECT memory_id, max("at") AS new_at, max_by(operation, ("at", sync_id)) FILTER (operation <> 'update') AS switch, count(*) FILTER (operation = 'create') AS made FROM ap GROUP BY memory_id)
SELECT memory_id, coalesce(fields, '') AS fields, coalesce(switch, '') <> 'delete' AS is_active, greatest(touched_at, new_at) AS touched_at FROM en FULL JOIN ed USING (memory_id) LEFT JOIN ma USING (memory_id) WHERE title IS NOT NULL OR made > 0""")
def y02_entries_after_pull(spark: SparkSession, sf: str) -> DataFrame:
    """The entries after the changes of a second replica: created, updated field by field, switched off."""
    after = replicas.apply_changes(_entries(spark, sf), _pulled(spark, sf))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return after.select("memory_id", text.alias("fields"), "is_active", "touched_at")
