"""Histories of memories that merge and split, and rollbacks to an earlier event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVOLVES, MERGES, SPLITS = "evolves_to", "merges_into", "splits_from"


def nearest(events: DataFrame, probes: DataFrame, before: bool) -> DataFrame:
    """``event_id, other_memory, found``: for ``probes(event_id, other_memory, at)`` the other memory's last event before the probe (or its first one after it).

    Events and probes go through one window a memory, so nothing meets in pairs and a memory of any length spills. Equal times go by event_id; an event is never
    its own neighbour. Without such an event there is no row.
    """
    rows = events.select("memory_id", "at", "event_id", F.col("event_id").alias("own"), F.lit(None).cast("bigint").alias("asks")).unionByName(
        probes.select(F.col("other_memory").alias("memory_id"), "at", "event_id", F.lit(None).cast("bigint").alias("own"), F.col("event_id").alias("asks"))
    )
    # an event and a probe of it share a place; it is left out as the frame of the probe ends before the place
    place = F.struct("at", "event_id")
    order = Window.partitionBy("memory_id").orderBy("at", "event_id", F.col("asks").isNull().cast("int"))
    if before:
        found = F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    else:
        back = Window.partitionBy("memory_id").orderBy(F.desc("at"), F.desc("event_id"), F.col("asks").isNull().cast("int"))
        found = F.last("own", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    hits = rows.select("memory_id", place.alias("place"), "asks", found.alias("found")).where("asks IS NOT NULL AND found IS NOT NULL")
    return hits.select(F.col("asks").alias("event_id"), F.col("memory_id").alias("other_memory"), "found")


def history_edges(events: DataFrame, links: DataFrame) -> DataFrame:
    """``from_event, to_event, relation`` of ``events(memory_id, event_id, at, kind)`` and ``links(event_id, other_memory)``: what a merge takes in, what a split gives off.

    Every event but a creation evolves from the one before it in its memory; the last event of a merge's source before it merges into it; the first event of what a
    split gives off after it splits from it. Repeated links count once; links of other kinds, of unknown events, or to memories without such an event give nothing.
    """
    order = Window.partitionBy("memory_id").orderBy("at", "event_id")
    chain = events.select(F.lag("event_id").over(order).alias("from_event"), F.col("event_id").alias("to_event"), "kind").where("from_event IS NOT NULL AND kind <> 'created'")
    named = links.where("other_memory IS NOT NULL").distinct().join(events.where("kind IN ('merged', 'split')").select("event_id", "at", "kind"), "event_id")
    merged = nearest(events, named.where("kind = 'merged'"), before=True)
    split = nearest(events, named.where("kind = 'split'"), before=False)
    edge = lambda rows, a, b, relation: rows.select(F.col(a).alias("from_event"), F.col(b).alias("to_event"), F.lit(relation).alias("relation"))
    return edge(chain, "from_event", "to_event", EVOLVES).union(edge(merged, "found", "event_id", MERGES)).union(edge(split, "event_id", "found", SPLITS))


#: What a snapshot can restore.
FIELDS = ("title", "content")


def rollback(events: DataFrame, entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with its ``outcome`` and, where it is ``restored``, the rolled-back event: ``changed`` fields, ``before_*`` and ``after_*`` of each field.

    ``events(event_id, memory_id, snapshot map<string,string>)``, ``entries(memory_id, title, content)``, ``requests(request_id, memory_id, target_event, at)``.
    Guards: ``missing event`` (null too), ``other memory``, ``empty snapshot`` (null too). Fields that the snapshot lacks stay as they are. Several requests for a memory
    are carried out in order of ``at, request_id``, so each starts from what the one before it left. A memory without an entry starts from nulls.
    """
    known = events.select(F.col("event_id").alias("target_event"), F.col("memory_id").alias("event_memory"), "snapshot")
    looked = requests.join(known, "target_event", "left")
    outcome = (
        F.when(F.col("event_memory").isNull(), "missing event").when(~F.col("event_memory").eqNullSafe(F.col("memory_id")), "other memory")
        .when(F.coalesce(F.size("snapshot"), F.lit(0)) <= 0, "empty snapshot").otherwise("restored")
    )
    judged = looked.withColumn("outcome", outcome).withColumn("snapshot", F.when(F.col("outcome") == "restored", F.col("snapshot")))
    now = judged.join(entries.select("memory_id", *(F.col(c).alias(f"entry_{c}") for c in FIELDS)), "memory_id", "left")
    order = Window.partitionBy("memory_id").orderBy("at", "request_id")

    def value(field: str, upto: int) -> Column:
        """The field after the requests up to this one (0) or the one before it (-1); a snapshot may hold a null, so values travel in structs."""
        held = F.when(F.map_contains_key("snapshot", F.lit(field)), F.struct(F.element_at("snapshot", field).alias("v")))
        last = F.last(held, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, upto))
        return F.when(last.isNotNull(), last["v"]).otherwise(F.col(f"entry_{field}"))

    done = F.col("outcome") == "restored"
    states = [F.when(done, value(c, upto)).alias(f"{side}_{c}") for side, upto in (("before", -1), ("after", 0)) for c in FIELDS]
    changed = F.when(done, F.array_join(F.array_sort(F.map_keys("snapshot")), ","))
    return now.select("request_id", "memory_id", "target_event", "at", "outcome", changed.alias("changed"), *states)


def restored_entries(entries: DataFrame, done: DataFrame) -> DataFrame:
    """The entries after a `rollback`: of each memory what its last restored request left."""
    last = done.where("outcome = 'restored'").groupBy("memory_id").agg(F.max_by(F.struct(*(f"after_{c}" for c in FIELDS)), F.struct("at", "request_id")).alias("last"))
    kept = entries.join(last, "memory_id", "left")
    return kept.select("memory_id", *(F.when(F.col("last").isNotNull(), F.col(f"last.after_{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS))
