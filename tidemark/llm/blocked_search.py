"""Ranked lexical search over posting lists cut into blocks of similar documents, exact.

Documents are vectors of term weights. They are clustered by their inner products with sampled centroids and cut into cells of similar
documents; the part of a posting list that lies in a cell is a block of that list. A block keeps a summary: the largest weight that any of
its documents has at each coordinate (term). Coordinates are kept where some item of the workload asks both terms, and only those of terms
at least as frequent as the list's: a document is searched for in the list of its rarest asked term, so the coordinates of rarer terms
cannot count there. The sum of a summary over an item's terms bounds the score of every document that the item can find in the block, in
whole numbers rounded up. A first pass scores each item's most promising block of every cell and so finds a score that ten documents reach;
a second pass skips a block only if its bound is below that score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ready, remove

TOP = 10
#: Documents of a cell, and the dense weights that a cell may have in memory (rows times terms).
CELL_ROWS, CELL_WEIGHTS = 1024, 8_000_000
#: Clusters: so many sampled documents are their centres. The sample places documents, it does not choose among them.
CENTRES = 64
#: Bounds use the so many rarest terms of an item, one by one; further terms count with the most that their weight allows.
COORDINATES = 256
#: Summary coordinates and terms that one pass may ask for; more items are searched in several passes.
PASS_PAIRS = 2_000_000
#: Bytes of the cells of a file of the index, about. Spark's reader takes up to a whole file into memory at a time, and a cell is a long row.
FILE_BYTES = 32 << 20
#: A term's weight times this is more than any score of it.
SCALE = 1_000_000

_LOWER_OR_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, Latin letters and all that is not ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_OR_SPACE).split()


def _asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])


def _vectors(words: list[bytes]):
    place = {w: k for k, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, times = [], [], []
            for value in batch.column(1):
                terms = terms_of(value.as_py())
                found = Counter(place[t] for t in terms if t in place)
                sizes.append(len(terms))
                ids.append(list(found))
                times.append(list(found.values()))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "n", "ids", "times"])
            yield out.filter(pa.array(np.array(sizes) > 0))

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["id", "df"])

    return run


@dataclass
class Workload:
    """The items of one pass and what the corpus says of their terms. All arrays are bounded by the pass. Terms are named by rank, rarest first."""

    rank: np.ndarray  # of each word of the vocabulary
    weight: np.ndarray  # by rank
    documents: int
    tokens: int
    items: list  # item ids
    asked: list[np.ndarray]  # of each item: its terms' ranks, ascending

    def __post_init__(self) -> None:
        pairs, owner, rest = [], [], []
        size = len(self.weight)
        for q, terms in enumerate(self.asked):
            near = terms[:COORDINATES]
            a, b = np.triu_indices(len(near))
            pairs.append(near[a] * size + near[b])
            owner.append(np.column_stack([np.full(len(terms), q), terms, np.arange(len(terms))]))
            far = self.weight[terms[COORDINATES:]]
            upto = np.concatenate([np.full(len(near), far.sum()), far[::-1].cumsum()[::-1]]) if len(far) else np.zeros(len(near), np.int64)
            rest.append(upto)
        flat = np.concatenate([np.zeros(0, np.int64), *pairs])
        self.pairs = np.unique(flat)  # (list, coordinate) of the summaries
        self.lists = np.concatenate([np.zeros((0, 3), np.int64), *owner])  # (item, list, place of the list in the item)
        self.rest = np.concatenate([np.zeros(0, np.int64), *rest])  # what coordinates beyond the summaries may add
        counts = np.concatenate([np.zeros(0, np.int64), *(np.maximum(0, min(len(t), COORDINATES) - np.arange(len(t))) for t in self.asked)])
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.flat = np.searchsorted(self.pairs, flat)

    def weights_of(self, n: np.ndarray, times: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """What each posting adds to a score: the contract's whole numbers."""
        m = 10 + (90 * n * self.documents) // self.tokens
        return self.weight[ranks] * ((1_000_000_000 * times) // (1000 * times + 8 * m))

    def bounds(self, summary: np.ndarray) -> np.ndarray:
        """Of every (item, list): no document whose rarest asked term is the list's scores above this, in units of SCALE."""
        sums = np.concatenate([[0], np.cumsum(summary[self.flat], dtype=np.int64)])
        return sums[self.ends[1:]] - sums[self.ends[:-1]] + self.rest


def _ragged(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().astype(kind, copy=False), lengths


def _centre(work: Workload, centres: np.ndarray):
    """The cluster whose centre is most similar, and the decade of the length: weights depend on both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            ids, lengths = _ragged(batch.column("ids"), np.int64)
            times, _ = _ragged(batch.column("times"), np.int64)
            ranks, doc = work.rank[ids], np.repeat(np.arange(len(n)), lengths)
            order = np.lexsort((ranks, doc))
            ranks, times = ranks[order], times[order]
            values = work.weights_of(n[doc], times, ranks).astype(np.float32)
            likeness = np.zeros((len(n), centres.shape[1]), np.float32)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            for a in range(0, len(n), 256):  # no document is without terms here
                b = min(len(n), a + 256)
                part = slice(edges[a], edges[b])
                likeness[a:b] = np.add.reduceat(values[part, None] * centres[ranks[part]], edges[a:b] - edges[a])
            yield pa.RecordBatch.from_arrays(
                [pa.array(likeness.argmax(1).astype(np.int32) if centres.shape[1] else np.zeros(len(n), np.int32)), batch.column("doc_id"), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ranks.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(times.astype(np.int32)))],
                names=["centre", "doc_id", "n", "ranks", "times"],
            )

    return run


class Cell:
    """Documents of a cell: their weights at the terms that occur, dense, terms in order of rank."""

    def __init__(self, work: Workload, n: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, times: np.ndarray) -> None:
        self.terms, column = np.unique(ranks, return_inverse=True)
        doc = np.repeat(np.arange(len(n)), lengths)
        self.weights = np.zeros((len(n), len(self.terms)), np.int64)
        self.weights[doc, column] = work.weights_of(n[doc], times, ranks)
        order = np.argsort(column, kind="stable")
        self.members, self.starts = doc[order], np.searchsorted(column[order], np.arange(len(self.terms) + 1))

    def block(self, k: int) -> np.ndarray:
        return self.members[self.starts[k] : self.starts[k + 1]]

    def summary(self, work: Workload) -> np.ndarray:
        """The largest weights of each block at the workload's coordinates, in units of SCALE rounded up. Ranks beside the list's go last, so
        that the many lists of rare terms have few documents and those of frequent terms few coordinates."""
        out = np.zeros(len(work.pairs), np.int32)
        size = len(work.weight)
        units = (-(-self.weights // SCALE)).astype(np.uint16)
        lists, coordinates = work.pairs // max(1, size), work.pairs % max(1, size)
        first, stop = np.searchsorted(lists, self.terms), np.searchsorted(lists, self.terms, "right")
        place = np.searchsorted(self.terms, coordinates)
        there = (place < len(self.terms)) & (self.terms[np.minimum(place, max(0, len(self.terms) - 1))] == coordinates) if len(self.terms) else np.zeros(len(coordinates), bool)
        for k in range(len(self.terms)):
            if first[k] < stop[k]:
                largest = units[self.block(k), k:].max(0)
                at = np.arange(first[k], stop[k])[there[first[k] : stop[k]]]
                out[at] = largest[place[at] - k]
        return out


def _cells(work: Workload, rows: int):
    """Runs of ``rows`` documents become cells: ids, postings, and the summaries of the blocks."""
    def made(batch: pa.Table) -> pa.RecordBatch:
        n = batch["n"].to_numpy()
        ranks, lengths = _ragged(batch["ranks"].combine_chunks(), np.int64)
        times, _ = _ragged(batch["times"].combine_chunks(), np.int64)
        cell = Cell(work, n, lengths, ranks, times)
        listed = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [listed(batch["doc_id"].to_pylist(), pa.int64()), listed(n, pa.int64()), listed(lengths.astype(np.int32), pa.int32()), listed(ranks.astype(np.int32), pa.int32()), listed(times.astype(np.int32), pa.int32()),
             listed(cell.summary(work), pa.int32())],
            names=["doc_ids", "n", "lengths", "ranks", "times", "summary"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, rows - count)
                held.append(part)
                count += len(part)
                batch = batch.slice(len(part))
                if count == rows:
                    yield made(pa.Table.from_batches(held))
                    held, count = [], 0
        if held:
            yield made(pa.Table.from_batches(held))

    return run


def _best(scores: np.ndarray, ids: list, top: int) -> list[int]:
    """Places of the highest scores; equal ones by ascending id, missing ids last."""
    return sorted(range(len(scores)), key=lambda k: (-scores[k], ids[k] is None, ids[k] or 0))[:top]


def _search(work: Workload, floor: np.ndarray | None, top: int):
    """Each task's best documents of every item. ``floor`` None: only the most promising block of each cell is scored; else every block whose
    bound reaches the item's floor or the task's own tenth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.zeros(len(work.items), np.int64) if floor is None else floor.copy()
        held: list[list[tuple[int, int | None]]] = [[] for _ in work.items]
        item, lists = work.lists[:, 0], work.lists[:, 1]
        edges = np.searchsorted(item, np.arange(len(work.items) + 1))
        for batch in batches:
            for row in range(len(batch)):
                value = lambda name, row=row: batch.column(name)[row].values
                bounds = work.bounds(value("summary").to_numpy())
                cell, ids = None, None
                alive = (bounds > 0) & (bounds * SCALE >= floors[item])
                for q in np.unique(item[alive]):
                    cell = cell or Cell(work, value("n").to_numpy(), value("lengths").to_numpy(), value("ranks").to_numpy().astype(np.int64), value("times").to_numpy().astype(np.int64))
                    ids = value("doc_ids").to_pylist() if ids is None else ids
                    own = np.arange(edges[q], edges[q + 1])
                    at = np.searchsorted(cell.terms, lists[own])
                    here = at < len(cell.terms)
                    here[here] = cell.terms[at[here]] == lists[own][here]
                    live = here & alive[own]
                    if floor is None and live.any():
                        most = np.flatnonzero(live)[bounds[own][live].argmax()]
                        live[:] = False
                        live[most] = True
                    if not live.any():
                        continue
                    docs = np.unique(np.concatenate([cell.block(k) for k in at[live]]))
                    scores = cell.weights[np.ix_(docs, at[here])].sum(1)
                    good = np.flatnonzero((scores > 0) & (scores >= floors[q]))
                    if len(good) > top:
                        good = good[scores[good] >= np.partition(scores[good], -top)[-top]]
                    if len(good):
                        held[q] += [(int(scores[g]), ids[docs[g]]) for g in good]
                        best = _best([s for s, _ in held[q]], [d for _, d in held[q]], top)
                        held[q] = [held[q][k] for k in best]
                        if len(best) == top:
                            floors[q] = max(floors[q], held[q][-1][0])
        flat = [(q, s, d) for q, found in enumerate(held) for s, d in found]
        columns = zip(*flat, strict=True) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "score", "doc_id"])

    return run


_FOUND = "item int, score long, doc_id long"


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)


def _one_pass(docs: DataFrame, asked: list, folder: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({w for r in asked for w in r["terms"]})
    vectors = f"{folder}/vectors"
    docs.mapInArrow(_vectors(words), "doc_id long, n long, ids array<int>, times array<int>").write.parquet(vectors)
    vectors = spark.read.parquet(vectors)
    documents, tokens = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for r in vectors.select("ids").mapInArrow(_frequencies(len(words)), "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():  # a row a word of the pass
        df[r["id"]] = r["df"]
    rank = np.empty(len(words), np.int64)
    rank[order := np.argsort(df, kind="stable")] = np.arange(len(words))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in df[order].tolist()], np.int64)
    place = {w: k for k, w in enumerate(words)}
    work = Workload(rank, weight, documents, max(1, tokens), [r["item_id"] for r in asked], [np.sort(rank[[place[w] for w in r["terms"]]]) for r in asked])

    sample = vectors.where(F.size("ids") > 0).orderBy(F.xxhash64("doc_id", "n", "ids")).limit(CENTRES).collect()
    centres = np.zeros((len(words), len(sample)), np.float32)
    for k, r in enumerate(sample):
        ranks = rank[np.array(r["ids"], np.int64)]
        centres[ranks, k] = work.weights_of(np.int64(r["n"]), np.array(r["times"], np.int64), ranks)
    centres /= np.maximum(1, np.linalg.norm(centres, axis=0))
    rows = int(max(16, min(CELL_ROWS, CELL_WEIGHTS // max(1, len(words)))))
    placed = vectors.where(F.size("ids") > 0).mapInArrow(_centre(work, centres), "centre int, doc_id long, n long, ranks array<int>, times array<int>")
    # Ties are dealt by a hash of the vector and the id: a large group of equal documents lies in many partitions.
    spread = F.xxhash64("doc_id", "ranks")
    near = placed.withColumns({"decade": F.floor(F.log2("n") * 2), "spread": spread}).repartitionByRange("centre", "decade", "spread").sortWithinPartitions("centre", "decade", "spread")
    schema = "doc_ids array<long>, n array<long>, lengths array<int>, ranks array<int>, times array<int>, summary array<int>"
    postings = 8 * int(df.sum()) // max(1, documents)  # bytes a document
    cells = max(1, FILE_BYTES // (4 * len(work.pairs) + (postings + 20) * rows))
    near.select("doc_id", "n", "ranks", "times").mapInArrow(_cells(work, rows), schema).write.option("maxRecordsPerFile", cells).parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")

    floor = np.zeros(len(asked), np.int64)
    first = _ranked(index.mapInArrow(_search(work, None, top), _FOUND), top)
    for r in first.where(F.col("rank") == top).select("item", "score").collect():  # a row an item of the pass
        floor[r["item"]] = r["score"]
    found = _ranked(index.mapInArrow(_search(work, floor, top), _FOUND), top)
    items = spark.createDataFrame(list(enumerate(work.items)), "item int, item_id long")
    found.join(F.broadcast(items), "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/found")
    remove(spark, f"{folder}/vectors")
    remove(spark, f"{folder}/index")
    return spark.read.parquet(f"{folder}/found")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the best ``top`` of ``docs(doc_id, text, ...)`` for every row of ``items(item_id, text, ...)``.

    Every row of ``docs`` with a term is a document, repeated rows too; rows without an id rank behind those of equal score. Null and empty
    texts have no terms: such documents are never found and do not count, such items find nothing. Rows that repeat an item are items of
    their own. Empty tables give no rows. Other columns are ignored. Items are searched in passes whose terms and summaries are
    bounded (``PASS_PAIRS``; one very long item is a pass), so what goes to the driver and to all tasks does not grow with the corpus.
    """
    spark: SparkSession = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = f"{spark.sparkContext.getCheckpointDir()}/search-{uuid.uuid4().hex}"
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_asked_terms, "item_id long, terms array<binary>")
    asked = asked.where(F.size("terms") > 0)
    asked.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/items")
    asked = spark.read.parquet(f"{folder}/items")
    size = F.size("terms").cast("long")
    pairs = asked.agg(F.coalesce(F.sum(F.least(size, F.lit(COORDINATES)) * F.least(size, F.lit(COORDINATES)) / 2 + size), F.lit(0.0))).first()[0]
    passes = math.ceil(pairs / PASS_PAIRS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(passes):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == k).collect()  # PASS_PAIRS in the mean
        if some:
            out = out.union(_one_pass(docs, some, f"{folder}/pass-{k}", top))
    return out
