"""Sessions of a stream: a key's events with no gap longer than ``gap`` between them, whatever order and batches they come in; late rows are kept and counted.

A batch store holds the open sessions (a snapshot by bucket), the closed ones (appended once, never read again), the late rows, and how far time has come.
Rows behind the watermark (the newest time of earlier batches less ``late``) go to the late table; all others can only touch sessions that are still open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.streaming.batch_store import BUCKETS, BatchStore

SESSIONS = "key bigint, start_at bigint, end_at bigint, n bigint"
LATE = "key bigint, at bigint"
MARK = "newest bigint"


def pieces(events: DataFrame, gap: int) -> DataFrame:
    """Events ``key, at`` as pieces of sessions: all of a key's events in one cell of the width of the gap are in one session, so they are counted before the shuffle,
    and a key with very many events is as many rows as it has cells."""
    return events.groupBy("key", F.floor(F.col("at") / gap).alias("cell")).agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count("*").alias("n")).drop("cell")


def joined(parts: DataFrame, gap: int) -> DataFrame:
    """Pieces ``key, start_at, end_at, n`` (they may overlap) as sessions."""
    order = Window.partitionBy("key").orderBy("start_at", "end_at")
    reach = F.max("end_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_at") - reach > gap), 1).otherwise(0)
    numbered = parts.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "nth").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n")).drop("nth")


def session_tables(gap: int, late: int) -> Callable[[DataFrame, BatchStore], dict[str, DataFrame]]:
    """What a batch of ``key, at`` (microseconds) writes, for `batch_store.run`. Rows without key or time are in no session."""

    def tables(batch: DataFrame, store: BatchStore) -> dict[str, DataFrame]:
        rows = batch.where("key IS NOT NULL AND at IS NOT NULL")
        mark = store.read("marks", MARK).agg((F.max("newest") - late).alias("mark"))  # one row, null in the first batch
        judged = rows.select("key", "at").join(F.broadcast(mark)).withColumn("is_late", F.coalesce(F.col("at") < F.col("mark"), F.lit(False)))
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        new = pieces(judged.where("NOT is_late"), gap).withColumn("bucket", bucket)
        touched = new.select("bucket").distinct()  # BUCKETS rows at most
        open_ = store.snapshot("open", SESSIONS).drop("batch").join(F.broadcast(touched), "bucket", "left_semi").where("key IS NOT NULL")
        whole = joined(new.drop("bucket").unionByName(open_.drop("bucket")), gap).join(F.broadcast(mark)).withColumn("bucket", bucket)
        closed = F.coalesce(F.col("end_at") + gap < F.col("mark"), F.lit(False))
        columns = ["key", "start_at", "end_at", "n"]
        # a bucket whose sessions are all closed still says that this batch wrote it, by a row without a key
        none = touched.select(*(F.lit(None).cast("bigint").alias(c) for c in columns), "bucket")
        return {
            "closed": whole.where(closed).select(*columns),
            "open": whole.where(~closed).select(*columns, "bucket").unionByName(none),
            "late": judged.where("is_late").select("key", "at"),
            "marks": rows.agg(F.max("at").alias("newest")).where("newest IS NOT NULL"),
        }

    return tables


def read_sessions(store: BatchStore) -> DataFrame:
    """``key, start_at, end_at, n, is_open`` of all sessions so far."""
    open_ = store.snapshot("open", SESSIONS).where("key IS NOT NULL")
    parts = [(store.read("closed", SESSIONS), False), (open_, True)]
    done, still = (rows.select("key", "start_at", "end_at", "n", F.lit(flag).alias("is_open")) for rows, flag in parts)
    return done.unionByName(still)


def late_counts(store: BatchStore) -> DataFrame:
    """``batch, n``: how many rows of each batch came too late."""
    return store.read("late", LATE).groupBy("batch").agg(F.count("*").alias("n"))
