"""One state a key in a stream: a newer state closes the one before, one that stays as it is for long is idle.

Value state holds the newest state of a key and how many were closed, whatever order the rows come in; an event-time timer marks it idle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, version bigint, event_id bigint, at bigint, k int, n_closed bigint, is_idle boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class NewestState(StatefulProcessor):
    def __init__(self, idle_seconds: int) -> None:
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "version bigint, event_id bigint, at bigint, k int, n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        version, event_id, at, k, n = self.newest.get() or (0, None, None, None, 0)
        for r in rows:
            n += 1
            if at is None or (r["at"], r["event_id"]) > (at, event_id):
                event_id, at, k = r["event_id"], r["at"], r["k"]
        self.newest.update((version + 1, event_id, at, k, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + self.idle * 1000)
        yield Row(key=key[0], version=version + 1, event_id=event_id, at=at, k=k, n_closed=n - 1, is_idle=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        version, event_id, at, k, n = self.newest.get()
        self.newest.update((version + 1, event_id, at, k, n))
        yield Row(key=key[0], version=version + 1, event_id=event_id, at=at, k=k, n_closed=n - 1, is_idle=True)

    def close(self) -> None:
        pass


def follow_states(states: DataFrame, folder: str, late: str = "365 days", idle_seconds: int = 30 * 86400) -> DataFrame:
    """``key, event_id, at, k, n_closed, is_idle`` for every key of a stream ``event_id, key, at (microseconds), k``.

    Run again over the same folder it goes on where it stopped. Rows that come later than ``late`` behind the newest are dropped by the watermark.
    """
    spark = states.sparkSession
    timed = states.withColumn("seen", F.timestamp_micros("at")).withWatermark("seen", late)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def save(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")

    try:
        out = timed.groupBy("key").transformWithState(NewestState(idle_seconds), OUT, "Update", "EventTime")
        out.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    written = spark.read.schema(f"{OUT}, batch long").parquet(f"{folder}/out")
    return written.groupBy("key").agg(F.max_by(F.struct("event_id", "at", "k", "n_closed", "is_idle"), "version").alias("v")).select("key", "v.*")
