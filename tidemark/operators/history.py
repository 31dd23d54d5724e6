"""Event histories, replicas and condensation of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(events: DataFrame, *order: str) -> DataFrame:
    """``memory_id, from_event, to_event``: every event of a memory evolves from the one before it."""
    w = Window.partitionBy("memory_id").orderBy(*order)
    edges = events.select("memory_id", F.lag("event_id").over(w).alias("from_event"), F.col("event_id").alias("to_event"))
    return edges.where("from_event IS NOT NULL")


def branch_points(events: DataFrame, root: str, branch: str) -> DataFrame:
    """``parent, n``: events of kind ``root`` from which more than one event of kind ``branch`` follows before the next root."""
    w = Window.partitionBy("memory_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("kind") == root, F.col("event_id")), ignorenulls=True).over(w)
    linked = events.select("kind", parent.alias("parent")).where((F.col("kind") == branch) & F.col("parent").isNotNull())
    return linked.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1")


def clamped_sum(changes: DataFrame, key: str, delta: str, *order: str) -> DataFrame:
    """Weight after all changes in order, never below zero: the plain sum, lifted by its deepest fall below zero.
    The running sum is a window, so that a key of any size spills instead of being collected."""
    running = F.sum(delta).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return changes.select(key, delta, running.alias("s")).groupBy(key).agg((F.sum(delta) - F.least(F.lit(0), F.min("s"))).alias("weight"))


def decide(remote: DataFrame, pending: DataFrame, key: str = "memory_id") -> DataFrame:
    """Remote changes against local pending ones: a newer local change makes a conflict, an equal one skips, else it applies."""
    local = pending.select(key, F.col("at").alias("local_at"))
    verdict = F.when(F.col("local_at") > F.col("at"), "conflict").when(F.col("local_at") == F.col("at"), "skip").otherwise("apply")
    return remote.join(local, key, "left").select(key, verdict.alias("decision"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: created, removed or updated; equal values (nulls too) give no row."""
    both = old.select(key, F.col(value).alias("was"), F.lit(True).alias("in_old")).join(new.select(key, F.col(value).alias("now"), F.lit(True).alias("in_new")), key, "full")
    change = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "updated")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def condensable(messages: DataFrame, keep: int, *order: Column | str) -> DataFrame:
    """Messages of a session older than its last ``keep``."""
    from_end = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return messages.withColumn("from_end", from_end).where(F.col("from_end") > keep).drop("from_end")


def merge_clocks(a: Column, b: Column) -> Column:
    """The larger tick of every node."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare_clocks(a: Column, b: Column) -> Column:
    """``equal``, or the one that is nowhere behind (``a`` or ``b``), or ``concurrent``; a missing node stands at 0."""
    differences = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    ahead, behind = F.exists(differences, lambda d: d > 0), F.exists(differences, lambda d: d < 0)
    return F.when(ahead & behind, "concurrent").when(ahead, "a").when(behind, "b").otherwise("equal")
