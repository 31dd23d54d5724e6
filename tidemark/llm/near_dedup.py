"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes) and a HyperMinHash
   sketch: 256 buckets, each with the leading-zero count and ten mantissa bits of its smallest hash.
   Copies with equal sets collapse into one node.
2. Empty buckets borrow from a filled one by a fixed random ranking, bands of registers give keys,
   and nodes sharing a key form candidate clusters (a star per key, then components; no pairs).
3. Inside a cluster, blocks of at most ``block`` nodes meet pairwise; sketches give the Jaccard estimate,
   corrected for chance register collisions, and pairs that pass are confirmed on the full sets by
   exact intersection counts. A block pair emits a spanning forest, never all its pairs.
4. Components of the confirmed links give the classes.

A pair at the threshold misses all bands with a chance of about 1e-6, and two of n different rows share a 64-bit key with one of about n * n / 4e19.
Links are lost in no other way. Keys that many rows share are joined by a broadcast of at most 1,000 rows (``join_counted``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, cut, join_counted, unboxed
from tidemark.llm.components import connected_components
from tidemark.llm.textkernel import batches, mix, shingle_set

BUCKETS, MANTISSA, VALUE_BITS = 256, 10, 56
SHINGLE = 5
BLOCK = 384
#: Pairs whose corrected estimate is this far below the threshold are not confirmed: over seven standard errors.
SLACK = 0.25
COLUMNS = 4096
#: log2 of the bits of the filter that tells candidates from other texts.
FILTER_LEAST, FILTER_MOST = 18, 27


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set: 0 for an empty bucket, else leading zeros and mantissa of its smallest hash."""
    low = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, (shingles & np.uint64(BUCKETS - 1)).astype(np.int64), shingles >> np.uint64(8))
    filled = low != np.iinfo(np.uint64).max
    part, power = np.frexp(np.where(filled, low, 1).astype(np.float64))
    code = ((VALUE_BITS - power).astype(np.int64) << MANTISSA) + ((part - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64) + 1
    return np.where(filled, code, 0).astype(np.uint16)


@lru_cache(maxsize=1)
def _ranking() -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)]).astype(np.int16)


def densify(registers: np.ndarray) -> np.ndarray:
    """Empty buckets take the register of the filled bucket that comes first in their own fixed ranking."""
    filled = np.flatnonzero(registers)
    if len(filled) in (0, BUCKETS):
        return registers
    out, empty = registers.copy(), np.flatnonzero(registers == 0)
    out[empty] = registers[filled[_ranking()[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_rows(threshold: float) -> int:
    return 7 if threshold >= 0.85 else 6


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """Keys of the bands of each sketch in ``registers`` (n x buckets)."""
    bands = BUCKETS // rows
    step = mix(np.arange(11, 11 + rows, dtype=np.uint64)) | np.uint64(1)
    code = registers[:, : bands * rows].astype(np.uint64).reshape(len(registers), bands, rows)
    return mix((code * step).sum(axis=2, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64) + np.uint64(977)))


_OCTAVE = 2.0 ** -np.arange(0, VALUE_BITS + 1)


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of buckets whose registers agree by chance for disjoint sets of n and m elements."""
    def octave(size: np.ndarray) -> np.ndarray:  # chance that a bucket's minimum lies in each octave
        alive = np.exp(-np.outer(size / BUCKETS, _OCTAVE))
        return np.diff(alive, axis=1, append=1.0)

    return (octave(np.asarray(n, float)) * octave(np.asarray(m, float))).sum(axis=1) / (1 << MANTISSA)


def _sketched(rows: int):
    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            for row, stop, words in batches(batch.column(2)):
                count, sig, regs = np.zeros(stop - row, np.int64), [None] * (stop - row), np.zeros((stop - row, BUCKETS), np.uint16)
                for d in range(stop - row):
                    s = shingle_set(words.hash[words.first[d] : words.first[d + 1]], SHINGLE)
                    if count_d := len(s):
                        count[d] = count_d
                        sig[d] = f"{int(mix(s).sum(dtype=np.uint64)):016x}{int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)):016x}{count_d:x}"
                        regs[d] = densify(sketch(s))
                keys = band_keys(regs, rows).astype(np.int64)
                width = keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, width, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, stop - row) for k in (0, 1)), pa.array(count), pa.array(sig, pa.string()), lists], names=["key", "doc_id", "n_shingles", "sig", "keys"])

    return run


def _sets(sent):
    """Sets and sketches of the documents whose key passes the candidate filter."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches_in:
            slot = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            take = (have[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(take.astype(bool)))
            for row, stop, words in batches(batch.column(1)):
                made = [shingle_set(words.hash[words.first[d] : words.first[d + 1]], SHINGLE) for d in range(stop - row)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array([s.tobytes() for s in made], pa.binary()), pa.array([sketch(s).tobytes() for s in made], pa.binary())],
                    names=["node", "shingles", "registers"],
                )

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the sets at ``left`` with those at ``right``, in column blocks of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.empty(len(values), bool)
    fresh[:1] = True
    fresh[1:] = values[1:] != values[:-1]
    column = np.cumsum(fresh) - 1
    keep = np.bincount(column)[column] > 1
    owner, column = owner[keep], column[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])])
    for base in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [base, base + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - base] = 1
        out += dense[left] @ dense[right].T
    return out


def confirmed(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], registers: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the nodes of one block, or between two (side 0 and 1)."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    sizes = np.array([len(s) for s in sets])
    floor = percent / 100 - SLACK
    chance: dict = {}
    hits = []
    for i, x in enumerate(left):
        others = np.arange(i + 1, len(right)) if right is left else np.arange(len(right))
        n, m = sizes[x], sizes[right[others]]
        others = others[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
        if not len(others):
            continue
        a, b = registers[x], registers[right[others]]
        same, live = ((b == a) & (b != 0)).sum(axis=1), ((b != 0) | (a != 0)).sum(axis=1)
        grade = (int(np.log2(n) * 2), tuple(np.unique((np.log2(sizes[right[others]]) * 2).astype(int))))
        if grade not in chance:  # expected collisions hardly move within half an octave of the sizes
            chance[grade] = BUCKETS * chance_matches(np.array([float(n)]), np.array([float(sizes[right[others]].max())]))[0]
        hits.append(np.column_stack([np.full(len(others), i), others])[(same - chance[grade]) / live >= floor])
    if not hits or not len(hits := np.concatenate(hits)):
        return []
    # a pair alone is cheaper to intersect than to multiply out
    if len(hits) <= 4:
        both = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in hits])
    else:
        both = _shared(sets, left, right)[hits[:, 0], hits[:, 1]].astype(np.int64)
    x, y = left[hits[:, 0]], right[hits[:, 1]]
    linked = 100 * both >= percent * (sizes[x] + sizes[y] - both)
    forest = _Forest(len(nodes))
    return [(int(nodes[p]), int(nodes[q])) for p, q in zip(x[linked], y[linked], strict=True) if forest.join(p, q)]


def _confirm(percent: int):
    def flush(rows: list) -> list[tuple[int, int]]:
        seen: dict = {}
        for node, side, s, r in rows:
            seen[node] = (side, s, r)
        if len(seen) < 2:
            return []
        nodes = np.array(list(seen))
        side = np.array([v[0] for v in seen.values()])
        sets = [np.frombuffer(v[1], np.uint64) for v in seen.values()]
        return confirmed(nodes, side, sets, np.stack([np.frombuffer(v[2], np.uint16) for v in seen.values()]), percent)

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cluster, i, j); each run of equal keys is one block pair of bounded size."""
        key, rows, found = None, [], []
        for batch in batches_in:
            cols = [batch.column(k).to_pylist() for k in range(4)] + [batch.column(4).to_pylist(), batch.column(5), batch.column(6)]
            for n, now in enumerate(zip(*cols[:3], strict=True)):
                if now != key:
                    found += flush(rows)
                    key, rows = now, []
                rows.append((cols[3][n], cols[4][n], cols[5][n].as_py(), cols[6][n].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
                found = []
        found = flush(rows)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _classes(docs: DataFrame, percent: int, block: int) -> DataFrame:
    """``key, doc_id, n_shingles, node, component_id`` for every row of ``docs(key, doc_id, text)``; node and component are null without shingles.

    The key is a hash of the row's content. A node is a set of shingles, named by the smallest key of its rows. Rows that share a doc_id are linked.
    """
    made = cut(docs.mapInArrow(_sketched(band_rows(percent / 100)), "key long, doc_id long, n_shingles long, sig string, keys array<long>"))
    full = made.where("sig is not null")
    nodes = cut(full.groupBy("sig").agg(F.min("key").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    rows, sets = (x or 0 for x in nodes.agg(F.sum("n"), F.count("*")).first())
    placed = cut(join_counted(full.select("key", "doc_id", "n_shingles", "sig"), nodes.select("sig", "node", "n"), "sig", rows).select("key", "doc_id", "n_shingles", "node"))

    banded = nodes.select("node", F.explode("keys").alias("band"))
    leads = cut(banded.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    stars = join_counted(banded, leads, "band", sets * (BUCKETS // band_rows(percent / 100))).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    clusters = cut(connected_components(stars))
    links = _links(docs, clusters, percent, block)

    several = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n")).where("first <> last")
    same_id = join_counted(placed.select("doc_id", "node"), several, "doc_id", rows).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    classes = connected_components(links.union(same_id))

    named = cut(nodes.select("node", "least", F.col("n").alias("rows")).join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_counted(named.select("component", "node", "rows"), least, "component", sets).select("node", F.col("rows").alias("n"), "component", "component_id")
    out = join_counted(placed, cut(named), "node", rows).select("key", "doc_id", "n_shingles", "component", "component_id")
    bare = made.where("sig is null").select("key", "doc_id", "n_shingles", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("component_id"))
    return out.union(bare)


def _texts(docs: DataFrame, *keyed: Column) -> DataFrame:
    return docs.select(F.xxhash64(*keyed).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Texts without words have an empty set and stand alone. Rows that share a doc_id are one document, whatever their texts: each has the size of
    its own set, and all of them are in one class. A row without a doc_id is in the class of its set like any other; a class
    without any doc_id has a null component, and its rows are all kept. Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    found = _classes(_texts(docs, F.col("doc_id").cast("long"), F.col("text").cast("string")), percent, block)
    alone = F.coalesce("component_id", F.when(F.col("component").isNull(), F.col("doc_id")))
    return found.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def one_of_each(docs: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without near copies: one row of each class, that of the smallest doc_id (ids before nulls, then
    by a hash of the whole row). Rows without words stay, wholly equal ones once. Names of further columns cannot clash with those used here."""
    columns = docs.columns
    whole = [F.to_json(docs[f"`{c}`"]) if kind.startswith("map") else docs[f"`{c}`"] for c, kind in docs.dtypes]
    found = _classes(_texts(docs, *whole), percent, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("first")
    best = found.where("component is not null").groupBy("component").agg(first).select(F.col("first.key").alias("key"))
    kept = best.union(found.where("component is null").select("key").distinct())
    rows = boxed(docs, F.xxhash64(*whole).alias("key"))
    # the join deals rows by their key, so equal rows meet without another shuffle
    return unboxed(rows.join(kept, "key", "left_semi").dropDuplicates(["key"]), columns)


def _links(docs: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    members = clusters.count()
    placed = join_counted(clusters, sizes, "component", members).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("mine", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    meets = placed.select(
        "node", F.col("component").alias("cluster"), "mine", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    ).select("node", "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.expr("case when mine > other then 1 else 0 end").alias("side"))
    # the filter follows the candidates up to a fixed size; beyond it more texts pass, which the join drops
    room = 1 << min(FILTER_MOST, max(FILTER_LEAST, (16 * members).bit_length()))
    slot = lambda node: F.pmod(F.xxhash64(node), F.lit(room))
    words = clusters.select(slot("node").alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    have = np.zeros(room // 64, np.uint64)
    for r in words.collect():
        have[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    sent = docs.sparkSession.sparkContext.broadcast(have)
    sets = docs.select(F.col("key").alias("node"), "text", slot("key").alias("slot")).mapInArrow(_sets(sent), "node long, shingles binary, registers binary")
    dealt = meets.join(sets, "node").select("cluster", "i", "j", "node", "side", "shingles", "registers")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return dealt.mapInArrow(_confirm(percent), "a long, b long")
