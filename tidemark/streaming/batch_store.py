"""Tables that a stream writes together: a batch is seen in all of them or in none, and a repeated batch changes nothing.

Every table is a Parquet folder with a folder a batch; the log, written last, names the batches that are whole and the buckets that each wrote. Readers go by the log, so
what a failed batch left behind is never read, and the batch's next run overwrites it. A merged table is read from the last folder of every bucket alone, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # a bit each in the log
LOG = "tables int, touched map<string, bigint>"


class BatchStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.touched: dict[int, Mapping[str, int]] = {}  # of whole batches: the buckets of each merged table

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def whole(self, batch: int) -> bool:
        return self._exists(f"log/batch={batch}/_SUCCESS")

    def batches(self) -> DataFrame:
        if not self._exists("log"):
            return self.spark.createDataFrame([], "batch long")
        return self.spark.read.schema("tables int, batch long").parquet(f"{self.folder}/log").select("batch")

    def write(self, batch: int, tables: Mapping[str, DataFrame]) -> None:
        """All tables of a batch, then its line in the log. A batch that the log holds is left as it is."""
        if self.whole(batch):
            return
        seen = {name: Observation() for name, rows in tables.items() if "bucket" in rows.columns}

        def put(name: str) -> None:
            rows = tables[name].observe(seen[name], F.bit_or(F.expr("shiftleft(1L, bucket)")).alias("touched")) if name in seen else tables[name]
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

        with ThreadPoolExecutor(max(1, len(tables))) as pool:  # the tables do not depend on each other
            list(pool.map(put, tables))
        touched = {name: s.get["touched"] or 0 for name, s in seen.items()}
        line = F.create_map(*(F.lit(x) for pair in touched.items() for x in pair)) if touched else F.create_map()
        line = self.spark.range(1).select(F.lit(len(tables)).alias("tables"), line.cast("map<string, bigint>").alias("touched"))
        line.write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
        self.touched[batch] = touched

    def _newest(self, name: str) -> dict[int, int]:
        """Of every bucket of a merged table the last whole batch that wrote it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/batch=*/_SUCCESS")
        whole = sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or [])
        unknown = [f"{self.folder}/log/batch={k}" for k in whole if k not in self.touched]
        if unknown:
            for r in self.spark.read.schema(f"{LOG}, batch long").option("basePath", f"{self.folder}/log").parquet(*unknown).collect():  # a row a batch
                if r["touched"] is None:
                    raise RuntimeError(f"the log of batch {r['batch']} names no buckets")
                self.touched[r["batch"]] = r["touched"]
        return {b: k for k in whole for b in range(BUCKETS) if self.touched[k].get(name, 0) >> b & 1}

    def read(self, name: str, schema: str) -> DataFrame:
        """Rows of whole batches, with their ``batch``. No table yet is an empty one."""
        if not self._exists(name):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")
        return rows.join(self.batches(), "batch", "left_semi")

    def snapshot(self, name: str, schema: str) -> DataFrame:
        """The rows of a merged table: of every bucket the last batch that wrote it."""
        newest = self._newest(name)
        if not newest:
            return self.spark.createDataFrame([], f"bucket int, batch long, {schema}")
        paths = [f"{self.folder}/{name}/batch={k}" for k in sorted(set(newest.values()))]
        rows = self.spark.read.schema(f"{schema}, bucket int, batch long").option("basePath", f"{self.folder}/{name}").parquet(*paths)
        last = F.create_map(*(F.lit(x) for pair in newest.items() for x in pair))
        return rows.where(last[F.col("bucket")] == F.col("batch")).select("bucket", "batch", *(c for c in rows.columns if c not in ("bucket", "batch")))

    def merged(self, name: str, schema: str, keys: list[str], changes: DataFrame, combine: Mapping[str, Callable[[Column, Column], Column]]) -> DataFrame:
        """What a batch writes to a merged table: the buckets that its changes touch, old and new values of each key combined.

        ``changes`` has one row a key. ``combine`` gives each value from the old and the new one, either of which may be null.
        """
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        new = changes.withColumn("bucket", bucket)
        old = self.snapshot(name, schema).drop("batch").join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")
        old = old.select(*keys, "bucket", *(F.col(c).alias(f"old_{c}") for c in combine))
        both = new.join(old, [*keys, "bucket"], "full")
        return both.select(*keys, *(f(F.col(f"old_{c}"), F.col(c)).alias(c) for c, f in combine.items()), "bucket")


def plus(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def run(stream: DataFrame, store: BatchStore, tables: Callable[[DataFrame, BatchStore], Mapping[str, DataFrame]], once: bool = False) -> None:
    """Every batch of the stream through ``tables``, whose results the store writes together. Offsets lie beside the tables, so a restart goes on where they end.
    ``once``: ``tables`` reads a batch once, so it need not be kept."""

    def save(batch: DataFrame, k: int) -> None:
        if not store.whole(k):
            if once:
                return store.write(k, tables(batch, store))
            batch.persist()
            try:
                store.write(k, tables(batch, store))
            finally:
                batch.unpersist()

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{store.folder}/offsets").trigger(availableNow=True).start().awaitTermination()
