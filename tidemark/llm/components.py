"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, forget, join_counted, let_go


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node ``a``, and how many neighbours it has."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest of itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("m", "a").alias("m"), "n")
    return join_counted(both.where("b > a"), least, "a", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them. Edges have a > b."""
    least = _least(edges)
    moved = join_counted(edges, least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node. Nodes are of any ordered type.

    Only a count and a checksum come to the driver. Every round is checkpointed, so a lost executor repeats one round at most; the files of the round before are deleted then. Nodes with very many
    neighbours are joined by a broadcast of at most 2,000 rows (``join_counted``). Loops, repeated edges and nulls are dropped first;
    no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        last, edges = edges, cut(_small_star(_large_star(edges, mark[0]), 2 * mark[0]))
        before, mark = mark, _mark(edges)
        forget(last)  # the next round stands on its own files
        let_go(edges.sparkSession)
        if mark == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
