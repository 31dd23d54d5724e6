"""Event tables replayed as streams: files in, idempotent batches out.

Each micro-batch overwrites its own folder, so a repeated batch after a failure leaves the same rows; of a key's updates the last batch counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import shared_folder


def stream(spark: SparkSession, path: str, per_batch: int = 64) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream of its files. The path goes in as a pattern, as only a folder may be named outright."""
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch)
    return feed.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(updates: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run the stream over all that is there and return the last update of every key."""
    spark = updates.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    values = [c for c in updates.columns if c not in keys]

    def save(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")

    run = updates.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    written = spark.read.schema(updates.schema.add("batch", "long")).parquet(f"{folder}/out")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """``start, *keys, n`` per tumbling window; rows later than ``late`` behind the newest are dropped by the watermark."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def current_state(events: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Keyed state: the value of each key's last event by ``order``, whatever order they arrive in."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def once(log: DataFrame, ts: str, late: str, key: str) -> DataFrame:
    """A log that may deliver a row again, each key once; the state of a key is let go ``late`` after its time."""
    return log.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")
