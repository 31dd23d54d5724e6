"""Small helpers that the operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every contract here takes them.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it has more than this share of the rows; so there are at most 1,000 hot keys.
HOT_SHARE, HOT_LEAST = 1000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names. Where none is named, a local session (tests) gets one of its own; on a
    cluster that would be lost with its machine, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Spark deletes shuffles and checkpoints when their owners are collected on the driver; loops of many small jobs ask for that now
    and then, as the cleaner itself does every half hour."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` made, once nothing reads it any more: Spark itself keeps them for ever by default."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        at = plan.rdd().getCheckpointFile()
        if at.isDefined():
            remove(df.sparkSession, at.get())


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """Join on ``key`` when some keys have very many of the ``total`` rows of ``left``.

    ``right`` has one row a key, and in ``count`` how many rows of ``left`` have it. Keys above a thousandth of the rows are at most
    1,000, so they are broadcast; no key that is shuffled has more rows than that. ``left`` is read twice, so it should be cheap or checkpointed.
    """
    limit = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(right.where(F.col(count) > limit))
    warm = left.join(hot, key)
    rest = left.join(F.broadcast(right.where(F.col(count) > limit).select(key)), key, "left_anti")
    return warm.unionByName(rest.join(right.where(F.col(count) <= limit), key, how))


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``doc``, beside further columns: none of its names can clash with theirs."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), *more)


def unboxed(rows: DataFrame, columns: Iterable[str], changed: Callable[[str], Column | None] = lambda c: None) -> DataFrame:
    """The columns of the struct again, those that ``changed`` names replaced."""
    return rows.select(*((F.col("doc")[c] if changed(c) is None else changed(c)).alias(c) for c in columns))


def unsigned_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: the folds of the contracts. A null id is in fold 0 as crc32('') = 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
