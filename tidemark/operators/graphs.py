"""Entity graphs: pairs, weights, neighbours and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

#: A task takes about so many rows of groups or pairs, where the number of tasks follows the input.
PART_ROWS = 500_000


def cooccurrence(members: DataFrame, group: str, item: str, block: int = 64) -> DataFrame:
    """``a, b, weight`` of unordered pairs of distinct items met in one group; null items meet nothing.

    A group of more than ``block`` rows is dealt into blocks by a hash of the item, and every two of its blocks meet in a cell of their own, so that no row
    holds a large group; pairs are made inside the row of a cell. The rows of a group are still counted, and its cells made, by one task, which spills.
    Groups and then pairs are dealt to as many tasks as their numbers ask for, so that a task's memory does not grow with the input.
    """
    n = F.col("n")
    rows, made = (int(x or 0) for x in members.groupBy(group).agg(F.count(item).alias("n")).agg(F.sum(n), F.sum(n * (n - 1) / 2)).first())
    parts = 1 + rows // PART_ROWS
    members = members.repartition(parts, group) if parts > 1 else members
    sized = members.where(F.col(item).isNotNull()).select(group, F.col(item).alias("item"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    dealt = sized.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    met = dealt.select(group, "item", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = met.groupBy(group, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(
        F.array_sort(F.collect_set(F.struct("item", "own"))).alias("items")
    )
    later = lambda x, i: F.filter(F.slice("items", i + 2, F.size("items")), lambda y: (F.col("low") == F.col("high")) | (x["own"] != y["own"]))
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(later(x, i), lambda y: F.struct(x["item"].alias("a"), y["item"].alias("b")))))
    met = cells.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    if parts > 1:
        met = met.repartition(1 + made // PART_ROWS, "a", "b")
    return met.groupBy("a", "b").agg(F.count("*").alias("weight"))


def diminishing(pairs: DataFrame, base: float = 1.0) -> DataFrame:
    """Edge weight where the n-th meeting adds less: w + base / (1 + .1 w)."""
    fold = F.aggregate(F.when(F.col("weight") > 1, F.sequence(F.lit(2), F.col("weight").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(base), lambda w, _: w + base / (1 + 0.1 * w))
    return pairs.select("a", "b", F.col("weight").alias("n"), F.round(fold, 6).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


def reached(ways: DataFrame, seed: DataFrame, depth: int) -> DataFrame:
    """``node, depth``: least number of steps from the seeds along ``ways(a, b)``, up to ``depth``. Each step is one join with the frontier, which
    is written before the next one: uncut, the plan would double at every step."""
    ways = cut(ways)
    seen = seed.select("node", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = ways.join(frontier, F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth")))
        seen = seen.union(frontier)
    return seen


def neighbours(edges: DataFrame, seed: DataFrame, depth: int) -> DataFrame:
    """``node, depth``: as ``reached``, along edges in both directions."""
    return reached(both_ways(edges).select("a", "b"), seed, depth)


def parents(edges: DataFrame, source: DataFrame, depth: int) -> DataFrame:
    """``node, depth, parent``: a tree of shortest paths from the nodes of ``source``, up to ``depth`` steps along edges in both directions. Of several parents the least
    counts; sources have none. Each step joins the frontier alone and is written before the next one."""
    ways = cut(both_ways(edges).select("a", "b"))
    frontier = seen = source.select("node", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent")).where("node IS NOT NULL").distinct()
    for d in range(1, depth + 1):
        step = ways.join(frontier, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        frontier = cut(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"))
        seen = seen.union(frontier)
    return seen


def paths(edges: DataFrame, source: DataFrame, targets: DataFrame, depth: int = 6) -> DataFrame:
    """``node, steps, path``: the nodes of a shortest path to each of the targets, source first; targets out of reach give no row.

    The walk back is one join a step, from the deepest targets up, with the parents of one depth only.
    """
    tree = cut(parents(edges, source, depth))
    ends = targets.select("node").distinct().join(tree, "node").select("node", F.col("depth").alias("steps"), "parent", F.array("node").alias("path"))
    for d in range(depth - 1, -1, -1):
        # the ends whose path begins at depth d + 1 go to their parents, the others wait; one join that keeps all, so that the plan grows by a step, not twofold
        asks = F.when(F.col("steps") - F.size("path") == d, F.col("parent"))
        level = tree.where(F.col("depth") == d).select(F.col("node").alias("asked"), F.col("parent").alias("above"))
        moved = ends.withColumn("asks", asks).join(level, F.col("asks") == F.col("asked"), "left")
        goes = F.col("asks").isNotNull()
        ends = moved.select(
            "node", "steps", F.when(goes, F.col("above")).otherwise(F.col("parent")).alias("parent"), F.when(goes, F.concat(F.array("asks"), "path")).otherwise(F.col("path")).alias("path")
        )
    return ends.select("node", "steps", "path")


def stats(edges: DataFrame) -> DataFrame:
    nodes = edges.select("a").union(edges.select("b")).distinct().agg(F.count("*").alias("n_nodes"))
    return edges.agg(F.count("*").alias("n_edges"), F.round(F.avg("weight"), 3).alias("mean_weight")).join(F.broadcast(nodes))  # one row each


def communities(edges: DataFrame) -> DataFrame:
    """``node, community``: the smallest node that can be reached. Every round passes the least label to the neighbours and
    then jumps to the label's own label, so that long chains take few rounds; only a changed-flag comes to the driver."""
    ways = cut(both_ways(edges).select("a", "b"))
    label = cut(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("community")))
    while True:
        near = ways.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("community").alias("near"))
        step = label.join(near, "node").select("node", F.col("community").alias("was"), F.least("community", "near").alias("mid"))
        jump = step.select(F.col("node").alias("via"), F.col("mid").alias("far"))
        # labels repeat, so each distinct one is looked up once; the label of a giant component is one key, which AQE splits
        hop = step.select(F.col("mid").alias("via")).distinct().join(jump, "via")
        moved = cut(step.join(hop, F.col("mid") == F.col("via")).select("node", "was", F.least("mid", "far").alias("community")))
        changed = moved.where("community <> was").limit(1).count()
        label = moved.select("node", "community")
        if not changed:
            return label


def ego(edges: DataFrame, node: int, n: int) -> DataFrame:
    """The strongest edges that touch a node."""
    return edges.where((F.col("a") == node) | (F.col("b") == node)).orderBy(F.desc("weight"), "a", "b").limit(n)
