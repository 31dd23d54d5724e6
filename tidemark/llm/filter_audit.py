"""How five filters interact: kept, removed and redundant documents of all 120 orders, and each filter's Shapley share.

Every text gives a mask of the filters that it fails. Counts by mask (32 at most a part) hold all that orders can ask for: the worth of a
coalition of filters is the number of documents that at least one of them fails. The potential of the removal game is computed
recursively over the 32 coalitions, P(S) = (worth(S) + sum of P(S without i)) / |S|; the Shapley value of a filter is P(all) less
P(all without it). Steps of an order are differences of worths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_ALL = (1 << len(FILTERS)) - 1


def text_mask(text: str) -> int:
    """Bits 0 to 3: the text fails A (few words), B (few distinct words), C (many capitals), D (holds a symbol)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at \x20 and \x09-\x0D only
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * capitals > CAPITAL_PERCENT * len(text),
        len(data.translate(None, _SYMBOLS)) < len(data),
    )
    return sum(1 << k for k, yes in enumerate(failed) if yes)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, codes = [], []
        for value in batch.column(2):
            text = value.as_py() or ""
            masks.append(text_mask(text))
            codes.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(codes, pa.binary())], names=["doc_id", "part", "mask", "code"])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters they fail.

    Filter E needs the whole table: a document fails it when a smaller id has the same text. Copies are pre-aggregated by text before any
    shuffle of them, so a text that a third of the rows share is one row a task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_masks, "doc_id long, part string, mask int, code binary")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce((F.col(a) == 1).cast("int"), F.lit(0)).alias(b) for a, b in (("quality", "good"), ("toxic", "toxic"))))
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    rows = rows.groupBy("doc_id", "code", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    same = rows.groupBy("code", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least")
    )
    first = F.min("least").over(Window.partitionBy("code"))  # a row for each part and label of a text
    own = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    same = same.withColumn("first", first).withColumn("own", own)
    both = F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    split = same.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _worths(counts: Column, field: str) -> Column:
    """An array over all coalitions S (bit sets, 0 first): documents that fail a filter of S."""
    failing = lambda s: F.filter(counts, lambda c: c["mask"].bitwiseAND(s) != 0)
    return F.transform(F.sequence(F.lit(0), F.lit(_ALL)), lambda s: F.aggregate(failing(s), F.lit(0).cast("long"), lambda total, c: total + c[field]))


def potentials(worth: Column) -> Column:
    """120 times the Hart-Mas-Colell potential of every coalition, in whole numbers (|S|! P(S) is whole). Subsets come before S."""
    scale = factorial(len(FILTERS))

    def next_one(done: Column, s: Column) -> Column:
        without = F.filter(F.transform(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), lambda bit: s.bitwiseAND(bit)), lambda bit: bit != 0)
        below = F.aggregate(without, F.lit(0).cast("long"), lambda total, bit: total + F.element_at(done, s - bit + 1))
        return F.concat(done, F.array(F.call_function("div", F.element_at(worth, s + 1) * scale + below, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ALL)), F.array(F.lit(0).cast("long")), next_one)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``docs(doc_id, text, lang, ...)``, ``labels(doc_id, quality, toxic, ...)``; other columns are ignored. Null texts are empty, a null lang
    is the part ``''``; a row without an id has no smaller one and is none. Rows that repeat an id and text are no copies of each other.
    Labels that repeat an id count if any of them says 1. An empty table has no parts and so no rows. The driver gets nothing.
    """
    cells = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # 32 at most
    parts = failure_counts(docs, labels).groupBy("part").agg(cells.alias("cells"), F.sum("n").alias("total"))
    parts = parts.select("part", "total", *(_worths(F.col("cells"), c).alias(f"by_{c}") for c in ("n", "good", "toxic")))
    parts = parts.withColumn("potential", potentials(F.col("by_n")))
    steps = []
    for order in permutations(range(len(FILTERS))):
        for k, i in enumerate(order):
            steps.append(f"{''.join(FILTERS[j] for j in order)}:{k + 1}:{1 << i}:{sum(1 << j for j in order[:k])}")
    field = F.split("step", ":")
    rows = parts.withColumn("step", F.explode(F.split(F.lit(" ".join(steps)), " ")))  # 600 rows a part
    rows = rows.withColumns({"filter_order": field[0], "step": field[1].cast("int"), "bit": field[2].cast("int"), "before": field[3].cast("int")})
    at = lambda name, s: F.element_at(F.col(name), s + 1)
    after, all_ = F.col("before") + F.col("bit"), F.lit(_ALL)
    gained = lambda name: at(name, after) - at(name, F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - at("by_n", after)).alias("kept"),
        gained("by_n").alias("removed"),
        (at("by_n", F.col("bit")) - gained("by_n")).alias("redundant"),
        (at("by_n", all_) - at("by_n", all_ - F.col("bit"))).alias("unique_fails"),
        gained("by_good").alias("good_lost"),
        gained("by_toxic").alias("toxic_lost"),
        (at("potential", all_) - at("potential", all_ - F.col("bit"))).alias("shapley"),
    )
