"""Store algebra: filters, ranked quotas, latest-wins merges and counts over memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier_rank() -> Column:
    return F.when(F.col("tier") == "impression", 0).when(F.col("tier") == "pattern", 1).otherwise(2)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Ordered cut; the last key must make the order total."""
    return df.orderBy(*order).limit(n)


def per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column | str, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key, with their place."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def by_scope(memories: DataFrame, scope: str, n: int) -> DataFrame:
    """Rows of one scope, strongest first: a cut in each tier, then over all."""
    order = (F.desc("decay"), F.desc("touched_at"), F.asc("entry_id"))
    return top(per_key(memories.where(F.col("scope_id") == scope), ["tier"], n, *order).drop("rn"), n, *order)


def by_time(memories: DataFrame, after: int | None = None, before: int | None = None, n: int | None = None) -> DataFrame:
    """Rows created in [after, before], both ends optional and included, newest first."""
    if after is not None:
        memories = memories.where(F.col("created_at") >= after)
    if before is not None:
        memories = memories.where(F.col("created_at") <= before)
    return memories if n is None else top(memories, n, F.desc("created_at"), F.asc("entry_id"))


def by_decay(memories: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """Weakest rows of the band, ``n`` in each tier, then cut in tier order."""
    ranked = per_key(memories.where(F.col("decay").between(low, high)), ["tier"], n, F.asc("decay"), F.desc("touched_at"), F.asc("entry_id"))
    return top(ranked.withColumn("tier_rank", tier_rank()), n, "tier_rank", "rn")


def latest(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last version of each key."""
    return per_key(rows, [key], 1, *order).drop("rn")


def decay_idle(memories: DataFrame, rate: float, now: int) -> DataFrame:
    """Rows idle before ``now`` lose ``rate``, not below zero."""
    return memories.withColumn("decay", F.when(F.col("touched_at") < now, F.greatest(F.lit(0.0), F.col("decay") - rate)).otherwise(F.col("decay")))


def touch(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Apply access events (entry_id, at): each adds a hit and 0.05 of decay, up to 1; the order of events does not matter."""
    per = accesses.groupBy("entry_id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    joined = memories.join(per, "entry_id", "left")
    return joined.withColumns({
        "hits": F.col("hits") + F.coalesce("n", F.lit(0)), "decay": F.least(F.lit(1.0), F.col("decay") + 0.05 * F.coalesce("n", F.lit(0))),
        "touched_at": F.greatest("touched_at", "at"),
    }).drop("n", "at")


def purge(memories: DataFrame, cutoff: int) -> DataFrame:
    """What is left when faded rows from before the cutoff go."""
    return memories.where(~((F.col("decay") <= 0) & (F.col("created_at") < cutoff)))


def decay_bands(memories: DataFrame) -> DataFrame:
    band = F.when(F.col("decay") >= 0.8, "fresh").when(F.col("decay") >= 0.5, "active").when(F.col("decay") >= 0.2, "fading").otherwise("forgotten")
    return memories.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
