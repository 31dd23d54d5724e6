"""Lineage cuts and scratch folders in the place the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of up to so many rows is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is named, a local session (tests) gets one of its own; on a cluster other machines
    could not read that, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their history, written to reliable storage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """Broadcast it if a count says that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
