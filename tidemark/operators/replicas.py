"""Replicas of memories: logs of changes, snapshots field by field, merges by clock, and changes of a second replica applied to a first one.

A version of a field is ``node, tick, clock, at, value``: the ``tick``-th change of that node, made when it knew ``clock`` (ticks by node). Another version
of the field covers it when that one's clock has reached its tick. What nothing covers survives, side by side with what was made without knowing of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import compare_clocks

VERSION = "struct<at:bigint,node:string,tick:bigint,value:string,clock:map<string,bigint>>"
LOG = "memory_id bigint, field string, node string, tick bigint, at bigint, value string, clock map<string,bigint>"
SNAPSHOT = f"memory_id bigint, fields map<string,array<{VERSION}>>"
CHANGE = "sync_id bigint, memory_id bigint, operation string, payload map<string,string>, node string, clock map<string,bigint>, at bigint, status string"
#: What a change can do, and where it stands.
OPERATIONS = ("create", "update", "delete")
PENDING, INFLIGHT, CONFLICT, DONE = "pending", "inflight", "conflict", "done"


def survivors(versions: Column) -> Column:
    """The versions that no other one covers, each once, the newest first. A repeated change (same node and tick) counts once, its newest copy."""
    known = lambda w, v: F.coalesce(F.try_element_at(w["clock"], v["node"]), F.lit(0))
    twin = lambda w, v: (w["node"] == v["node"]) & (w["tick"] == v["tick"])
    later = lambda w, v: F.when(w["at"] == v["at"], F.coalesce(w["value"], F.lit("")) > F.coalesce(v["value"], F.lit(""))).otherwise(w["at"] > v["at"])
    covered = lambda w, v: F.when(twin(w, v), later(w, v)).when(w["node"] == v["node"], w["tick"] > v["tick"]).otherwise(known(w, v) >= v["tick"])
    kept = F.filter(versions, lambda v: ~F.exists(versions, lambda w: covered(w, v)))
    place = lambda v: F.struct(v["at"], v["node"], v["tick"], v["value"])
    # clocks are maps, which have no order and no equality: of the twins that are alike in all else the first stays
    single = F.filter(kept, lambda v, i: ~F.exists(F.slice(kept, 1, i), lambda w: place(w).eqNullSafe(place(v))))
    return F.array_sort(single, lambda x, y: F.when(place(x) > place(y), -1).when(place(x) < place(y), 1).otherwise(0))


def snapshot_of(log: DataFrame) -> DataFrame:
    """`SNAPSHOT` of a log (`LOG`): one row a memory, its fields as maps to what survives.

    Of every node only the last change of a field can survive, so the log is first brought down to one row a memory, field and node, before the shuffle
    as far as can be; then a field holds at most one version a node. Rows without memory, field, node or tick are no changes.
    """
    whole = log.where("memory_id IS NOT NULL AND field IS NOT NULL AND node IS NOT NULL AND tick IS NOT NULL")
    version = F.struct(F.coalesce("at", F.lit(0)).alias("at"), "node", "tick", "value", F.coalesce("clock", F.create_map().cast("map<string,bigint>")).alias("clock"))
    newest = F.struct("tick", F.coalesce("at", F.lit(0)), F.coalesce("value", F.lit("")))
    last = whole.select("memory_id", "field", "node", newest.alias("newest"), version.alias("v")).groupBy("memory_id", "field", "node").agg(F.max_by("v", "newest").alias("v"))
    fields = last.groupBy("memory_id", "field").agg(survivors(F.collect_list("v")).alias("versions"))
    return fields.groupBy("memory_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "versions")), lambda x, y: F.when(x["field"] < y["field"], -1).otherwise(1))).alias("fields"))


def merge_fields(a: Column, b: Column) -> Column:
    """Two maps of fields as one: of each field, what survives among the versions of both. Commutes, associates, and a map merged with itself stays."""
    none = F.array().cast(f"array<{VERSION}>")
    empty = F.create_map().cast(f"map<string,array<{VERSION}>>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: survivors(F.concat(F.coalesce(x, none), F.coalesce(y, none))))


def merge_snapshots(local: DataFrame, remote: DataFrame) -> DataFrame:
    """`SNAPSHOT` of both replicas. Each has one row a memory, so no key is hot; memories of one replica alone stay as they are."""
    both = local.select("memory_id", F.col("fields").alias("mine")).join(remote.select("memory_id", F.col("fields").alias("theirs")), "memory_id", "full")
    return both.select("memory_id", merge_fields(F.col("mine"), F.col("theirs")).alias("fields"))


def field_rows(snapshot: DataFrame) -> DataFrame:
    """``memory_id, field, place, value, node, at, conflict``: what survives of every field. Place 1 (the newest, then the greatest node) is the field's value;
    further places are the conflict rows, kept for whoever resolves them."""
    fields = snapshot.select("memory_id", F.explode("fields").alias("field", "versions"))
    rows = fields.select("memory_id", "field", (F.size("versions") > 1).alias("conflict"), F.posexplode("versions").alias("place", "v"))
    return rows.select("memory_id", "field", (F.col("place") + 1).alias("place"), "v.value", "v.node", "v.at", "conflict")


def open_log(spark: SparkSession, path: str, me: str) -> DataFrame:
    """Changes (`CHANGE`) that a second replica's folder still has to hand over and that others than ``me`` made. It is only read. No folder there is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no replica at {path}")
    return spark.read.schema(CHANGE).parquet(path).where((F.col("status") == PENDING) & (F.col("node") != me))


def judge(changes: DataFrame, entries: DataFrame, pending: DataFrame, me: str) -> DataFrame:
    """The changes with their ``decision``: ``conflict`` where a change of ``me`` to that memory still waits and knows as little of this one as this one of it;
    ``skip`` where the entry was touched at that time or later; ``conflict`` for an operation that is none; else ``apply``.

    ``entries``: one row a memory with ``touched_at``. Of several waiting changes to a memory any concurrent one is a conflict.
    """
    # clocks of one memory's waiting changes: as many as a replica has not handed over yet, so they are judged row by row, not collected
    waits = pending.where((F.col("node") == me) & F.col("status").isin(PENDING, INFLIGHT)).select("memory_id", F.col("clock").alias("my_clock"))
    clash = changes.join(waits, "memory_id").where(compare_clocks(F.col("my_clock"), F.col("clock")) == "concurrent").select("sync_id").distinct().withColumn("clash", F.lit(True))
    known = changes.join(clash, "sync_id", "left").join(entries.select("memory_id", "touched_at"), "memory_id", "left")
    decision = (
        F.when(F.col("clash") | F.col("operation").isNull() | ~F.col("operation").isin(*OPERATIONS), "conflict").when(F.col("at") <= F.col("touched_at"), "skip").otherwise("apply")
    )
    return known.withColumn("decision", decision).drop("clash", "touched_at")


def apply_changes(entries: DataFrame, judged: DataFrame) -> DataFrame:
    """``memory_id, fields map<string,string>, is_active, touched_at`` after the changes judged ``apply``, oldest first.

    Every field takes its last change; a delete only turns ``is_active`` off, a create on. A memory that only updates or deletes name is not made. Changes are brought
    to one row a memory and field first; equal times go by sync_id.
    """
    todo = judged.where("decision = 'apply'")
    when = F.struct("at", "sync_id")
    set_ = todo.where("operation <> 'delete'").select("memory_id", when.alias("when"), F.explode("payload").alias("field", "value"))
    last = set_.groupBy("memory_id", "field").agg(F.max_by("value", "when").alias("value"))
    maps = last.groupBy("memory_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("new_fields"))
    switch = F.when(F.col("operation") != "update", when)
    ends = todo.groupBy("memory_id").agg(F.max("at").alias("new_at"), F.max_by("operation", switch).alias("switch"), F.count_if(F.col("operation") == "create").alias("made"))
    joined = entries.withColumn("known", F.lit(True)).join(ends, "memory_id", "full").join(maps, "memory_id", "left").where("known OR made > 0")
    none = F.create_map().cast("map<string,string>")
    fields = F.map_zip_with(F.coalesce("fields", none), F.coalesce("new_fields", none), lambda k, old, new: F.when(F.map_contains_key(F.coalesce("new_fields", none), k), new).otherwise(old))
    active = F.when(F.col("switch") == "delete", False).when(F.col("switch") == "create", True).otherwise(F.coalesce("is_active", F.lit(True)))
    return joined.select("memory_id", fields.alias("fields"), active.alias("is_active"), F.greatest("touched_at", "new_at").alias("touched_at"))


def handed_over(judged: DataFrame) -> DataFrame:
    """The log's new ``status`` of every judged change."""
    return judged.select("sync_id", F.when(F.col("decision") == "conflict", CONFLICT).otherwise(DONE).alias("status"))
