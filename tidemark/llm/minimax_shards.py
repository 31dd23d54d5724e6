"""Sharding by the minimax contiguous partition: the smallest capacity, found by bisection and greedy checks.

Groups (equal texts) are atomic and ordered by a hash of the text. Bins of the hash order stand for many groups, so a capacity can only be
bracketed: a sweep that keeps bins whole needs no less than the true one, a sweep that may cut anywhere inside a bin needs no more. While the two
differ, the bins in which a cut of any capacity between them can fall are split again by more hash bits; they meet at the
smallest capacity of the groups themselves. A group above the mean load would force that capacity on all shards
and leave some empty, so such giants come first in order, with a shard each, and the sweep deals with the others.
Histograms are of bounded size (``BINS`` new bins a round), whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, unsigned_crc

BINS = 1 << 16
OVERHEAD = 16
HASH_BITS = 62
#: Rows of one shard that are numbered together, about.
CELL_ROWS = 1 << 20


def sweep(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards when each takes as many ordered items as fit; None if that needs more than ``shards``."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends, at = [], 0
    while at < len(sizes):
        if len(ends) == shards:
            return None
        stop = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        if stop == at:
            return None
        ends.append(stop)
        at = stop
    return ends


def bisect(low: int, high: int, fits: Callable[[int], bool]) -> int:
    """The least capacity that fits; ``high`` does."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Bisection for the least capacity that the sweep can keep."""
    total = int(sizes.sum())
    return bisect(max(int(sizes.max(initial=0)), -(-total // shards)), total, lambda c: sweep(sizes, c, shards) is not None)


def reach(total: np.ndarray, whole: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Where the cuts of the sweep lie at the furthest, if bins that are not ``whole`` can be cut anywhere; None if the end is out of reach."""
    at, cuts = 0, []
    for _ in range(shards):
        if at >= total[-1]:
            break
        goal = at + capacity
        k = int(np.searchsorted(total, goal, "right")) - 1  # the bin in which it falls
        if k >= len(whole):
            goal = int(total[-1])
        elif whole[k]:
            goal = int(total[k])
        if goal <= at:
            return None
        at = goal
        cuts.append(at)
    return np.array(cuts) if at >= total[-1] else None


def doubtful(sizes: np.ndarray, whole: np.ndarray, shards: int) -> tuple[int, int, np.ndarray]:
    """(least capacity that may do, least that surely does, bins in which a cut of a capacity between them can fall)."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    high = smallest_capacity(sizes, shards)
    atoms = int(sizes[whole].max(initial=0))
    low = bisect(min(high, max(atoms, -(-int(total[-1]) // shards))), high, lambda c: reach(total, whole, c, shards) is not None)
    if low == high:
        return low, high, np.zeros(0, np.int64)
    # the k-th cut lies between the sweep over whole bins at the least capacity and the furthest reach at the greatest
    near, far = 0, 0
    split = np.zeros(len(sizes), bool)
    for _ in range(shards):
        near_end = int(np.searchsorted(total, total[near] + low, "right")) - 1
        goal = far + high - 1
        k = int(np.searchsorted(total, goal, "right")) - 1
        far_bin = min(k, len(sizes) - 1)
        far = min(int(total[-1]), int(total[k]) if k < len(whole) and whole[k] else goal)
        split[min(near_end, len(sizes) - 1) : far_bin + 1] = True
        near = near_end
        if far >= total[-1] and near >= len(sizes):
            break
    return low, high, np.flatnonzero(split & ~whole)


def balanced_ends(sizes: np.ndarray, shards: int) -> list[int]:
    """Cuts that keep the smallest capacity, yet leave the last shard as full as the others: a cut comes early when
    the rest can do with the remaining shards at its mean load."""
    capacity = smallest_capacity(sizes, shards)
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends, at = [], 0
    for k in range(shards):
        left = shards - k
        goal = total[at] + (total[-1] - total[at]) / left
        stop = int(np.searchsorted(total, goal, "right")) - 1
        if stop < len(sizes) and total[stop + 1] - goal < goal - total[stop] and total[stop + 1] - total[at] <= capacity:
            stop += 1
        # never so early that the rest no longer fits
        far = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        while stop < far and left > 1 and sweep(sizes[stop:], capacity, left - 1) is None:
            stop += 1
        stop = max(at, min(stop, far)) if left > 1 else len(sizes)
        ends.append(stop)
        at = stop
    return ends


def _histogram(groups: DataFrame, shift: int) -> DataFrame:
    return groups.groupBy(F.shiftright(F.col("h"), shift).alias("bin")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))


def _spans(items: list[tuple[int, int, int]], picked: np.ndarray) -> list[tuple[int, int]]:
    """Hash ranges of the picked bins, neighbours as one."""
    out: list[list[int]] = []
    last = None
    for k in picked:
        if last is not None and k == last + 1:
            out[-1][1] = items[k][1]
        else:
            out.append([items[k][0], items[k][1]])
        last = k
    return [(a, b) for a, b in out]


def cut_keys(groups: DataFrame, shards: int, bins: int = BINS) -> list[int]:
    """Largest hash of every shard but the last, for ``groups(h, bytes)``: a partition of the smallest capacity.

    Items are bins of the hash order. Each round splits only the bins that are in doubt, into up to ``bins`` new ones in all.
    """
    shift = HASH_BITS - (bins.bit_length() - 1)
    items = sorted((r["lo"], r["hi"], r["bytes"]) for r in _histogram(groups, shift).collect())
    if not items:
        return [0] * (shards - 1)
    while True:
        sizes = np.array([x[2] for x in items], np.int64)
        whole = np.array([x[0] == x[1] for x in items])
        picked = doubtful(sizes, whole, shards)[2]
        if not len(picked):
            # the capacity is settled; whole bins around the cuts of the balanced partition keep it
            ends = balanced_ends(sizes, shards)
            return [items[e - 1][1] if e else -1 for e in ends[:-1]]
        shift = max(0, shift - max(1, (bins // len(picked)).bit_length() - 1))
        inside = groups.where(" or ".join(f"h between {lo} and {hi}" for lo, hi in _spans(items, picked)))
        fresh = [(r["lo"], r["hi"], r["bytes"]) for r in _histogram(inside, shift).collect()]
        gone = set(picked.tolist())
        items = sorted([x for k, x in enumerate(items) if k not in gone] + fresh)


def minimax_shards(docs: DataFrame, shards: int = 40, bins: int = BINS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs(doc_id, text, ...)``.

    Law 'bytes'. Null text is a group of its own, like any text (it has size 16, as the empty one has, but another
    group). Rows with equal texts share a shard, repeated rows too. An empty table gives no rows; shards may stay empty when there are
    fewer groups than shards. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        unsigned_crc(text).alias("text_crc32"), F.shiftright(F.xxhash64(text, text.isNull()), 2).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("h"),
    ))
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("bytes")))
    giants, left = [], shards
    total, count = groups.agg(F.sum("bytes")).first()[0] or 0, rows.count()
    while left > 1 and total:  # at most `shards` groups can be above the mean of their round
        top = groups.where(F.col("bytes") > total / left).where(~F.col("h").isin([g[0] for g in giants]) if giants else F.lit(True)).orderBy(F.desc("bytes"), "h").limit(left - 1).collect()
        if not top:
            break
        giants += [(r["h"], r["bytes"]) for r in top]
        total, left = total - sum(r["bytes"] for r in top), left - len(top)
    big = {h: k for k, (h, _) in enumerate(giants)}
    keys = cut_keys(groups.where(~F.col("h").isin(list(big))) if big else groups, left, bins)
    shard = F.lit(len(big)) + sum((F.col("h") > F.lit(k)).cast("int") for k in keys) if keys else F.lit(len(big))
    for h, k in big.items():
        shard = F.when(F.col("h") == h, k).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    # slots: offsets of (hash bin, salt) cells of each shard, then places inside a cell. Even if one text has all the rows, its cells stay small
    salt = max(16, -(-count // CELL_ROWS))
    placed = placed.withColumn("cell", F.shiftright("h", HASH_BITS - 10) * salt + F.pmod(F.xxhash64("doc_id", "size"), F.lit(salt)))
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("shard", "cell", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "h", "size")) - 1
    out = placed.withColumn("within", within).join(cells, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
