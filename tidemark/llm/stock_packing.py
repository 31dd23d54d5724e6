"""Packing documents into sequences as a cutting-stock problem, solved by column generation.

Documents become token ids and an end id. Longer ones are cut into full pieces, each a sequence, and a shorter rest. Rests and short
documents are counted in length classes, rounded up, so that the linear program has one row a class at any corpus size: least
sequences with patterns of classes that fit, sum of patterns = histogram. The simplex basis starts with one class a pattern; a knapsack by dynamic
programming prices new patterns from the dual values until none is worth more than its sequence. Counts are rounded, what is left is packed
best fit. A piece takes the place of its rank among the pieces of its class.

Rounding up leaves small gaps. A reserve of pieces, drawn by hash, is laid out on a line and cut to fill the gaps exactly; what is left of it
fills whole sequences and then sequences of powers of two, which need no padding. All other documents of up to a sequence stay whole.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.best_fit_packing import best_fit
from tidemark.llm.common import cut

LENGTH, END = 4096, 2
CLASSES = 256
#: One piece in so many is in the reserve; at least so many pieces in the mean.
RESERVE_SHARE, RESERVE_LEAST = 64, 16
CELL_ROWS, MOST_CELLS = 500, 65536
CACHE = 500_000
#: The linear program stops when its value is this near to the bound that the prices give.
NEAR_ENOUGH = 3e-4

#: Texts of these characters are split by a plain pattern below: composed Latin letters, whose lower case is one letter, and ASCII without
#: the four signs that only Python takes for white space.
_PLAIN = re.compile(r"[\x00-\x1B\x20-\x7FÀ-ÖØ-öø-įı-ž]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^ \t\n\v\f\ra-z0-9ß-öø-ž]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _codes_words(path: str) -> dict | None:
    """The model's part of the file, if it lower-cases and then codes each match of the word pattern by itself, as bytes."""
    with open(path) as f:
        parts = json.load(f)
    try:
        steps = [x["type"] for x in parts["normalizer"]["normalizers"]]
        split, bytes_ = parts["pre_tokenizer"]["pretokenizers"]
        splits = steps == ["NFC", "Replace", "Lowercase"] and split["pattern"] == {"Regex": _SPLIT} and split["invert"] and split["behavior"] == "Removed"
        plain = bytes_["type"] == "ByteLevel" and not bytes_["add_prefix_space"] and not bytes_["use_regex"] and parts["post_processor"] is None
        model = parts["model"]
        merges_only = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        return model if splits and plain and merges_only else None
    except (KeyError, TypeError, IndexError, ValueError):
        return None


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Exact ids (little-endian, 32 bits) of the tokenizer file at ``path``. Where the file codes words one by one, runs between white space and their words
    are remembered, and a new word goes to the file's model alone."""
    from tokenizers import Tokenizer, models

    whole = Tokenizer.from_file(path)
    coded = lambda text: np.array(whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
    if not (parts := _codes_words(path)):
        return coded
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    letters = _byte_letters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["merges"]]
    model = models.BPE(vocab=parts["vocab"], merges=pairs, cache_capacity=0, end_of_word_suffix=parts["end_of_word_suffix"])  # words are remembered here
    words: dict[str, bytes] = {}
    runs: dict[str, bytes] = {}

    def code(word: str) -> bytes:
        got = words.get(word)
        if got is None:
            got = b"".join(t.id.to_bytes(4, "little") for t in model.tokenize(word.encode().decode("latin-1").translate(letters)))
            if len(word) < 40:
                if len(words) >= CACHE:
                    words.clear()
                words[word] = got
        return got

    def encode(text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in special):
            return coded(text)
        every = text.lower().split()
        parts = []
        for a in range(0, len(every), CACHE):
            some = every[a : a + CACHE]
            if new := set(some).difference(runs):
                if len(runs) + len(new) > CACHE:
                    runs.clear()
                    new = set(some)
                for run in new:
                    runs[run] = b"".join(map(code, _PIECE.findall(run)))
            parts += map(runs.__getitem__, some)
        return b"".join(parts)

    return encode


def _drawn(row: int, share: float) -> bool:
    return zlib.crc32(row.to_bytes(8, "little")) < share * 2**32


def _cut_up(path: str, length: int, end: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = encode(text.as_py() or "") + end.to_bytes(4, "little")
                total = len(tokens) // 4
                for a in range(0, total, length):
                    data = tokens[4 * a : 4 * (a + length)]
                    spare = len(data) < 4 * length and _drawn(row, share)
                    for column, value in zip(rows, (doc, a, len(data) // 4, zlib.crc32(data), total, spare, data if spare else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spare", "ids"])

    return run


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``best[c]``: the most that items of sizes 1, 2, ... (``values[size]``, any number of each) are worth in ``c``; ``last[c]``: one of them, or 0 for room left over."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        got = values[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(got.argmax())
        best[c], last[c] = (got[k], k + 1) if got[k] > best[c - 1] else (best[c - 1], 0)
    return best, last


def _filled(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room:
        size = int(last[room])
        out += [size] if size else []
        room -= size or 1
    return out


def generate(histogram: np.ndarray, capacity: int, columns: int = 8, most: int = 20_000) -> tuple[list[list[int]], np.ndarray, float]:
    """(patterns, how often each, lower bound): the linear program of the histogram (index: size), by column generation.

    Every pricing gives the best pattern and, for each size, the best that holds it; up to ``columns`` of these that still pay enter the
    basis, one pivot each. Prices lean to those of the best bound so far, which keeps them from swinging (a quarter of the pivots); the lean
    shrinks when it finds nothing. The bound is the worth of all sizes over that of the dearest pattern.
    """
    sizes = np.flatnonzero(histogram)
    row_of = np.zeros(capacity + 1, np.int64)
    row_of[sizes] = np.arange(len(sizes))
    patterns = [[int(s)] * (capacity // int(s)) for s in sizes]
    copies = np.array([len(p) for p in patterns], float)
    inverse, x = np.diag(1 / copies), histogram[sizes] / copies
    bound, centre, lean = 0.0, sizes / capacity, 0.8
    dual = inverse.sum(0)
    for _ in range(most):
        price = lean * centre + (1 - lean) * dual
        worth = np.full(capacity + 1, -np.inf)
        worth[sizes] = price
        best, last = knapsack(worth, capacity)
        if (got := float(histogram[sizes] @ price / best[capacity])) > bound:
            bound, centre = got, price / best[capacity]
        if x.sum() - bound <= NEAR_ENOUGH * bound:
            break
        entered = 0
        for k in np.argsort(-price - best[capacity - sizes], kind="stable")[:columns]:
            pattern = sorted([int(sizes[k]), *_filled(last, capacity - int(sizes[k]))], reverse=True)
            rows, times = np.unique(row_of[pattern], return_counts=True)
            if dual[rows] @ times <= 1 + 1e-9:
                continue
            step = inverse[:, rows] @ times
            up = np.flatnonzero(step > 1e-9)
            ratio = x[up] / step[up]
            out, most_ = int(up[ratio.argmin()]), float(ratio.min())
            x = np.maximum(0, x - most_ * step)
            x[out] = most_
            pivot = inverse[out] / step[out]
            step[out] -= 1
            moved = np.flatnonzero(step)
            inverse[moved] -= np.outer(step[moved], pivot)
            dual, entered = inverse.sum(0), entered + 1
            patterns[out] = pattern
        if not entered:
            if not lean:
                break
            lean = lean / 2 if lean > 0.01 else 0.0
    return patterns, x, bound


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that use up ``histogram`` (index: size), the fullest first."""
    left, out = histogram.astype(np.int64).copy(), []
    if left.any():
        patterns, x, _ = generate(histogram, capacity)
        down = np.floor(x + 1e-6)
        for add, order in ((down, range(len(x))), (np.ones(len(x)), np.argsort(down - x, kind="stable"))):  # whole sequences, then one more by the fraction
            for k in order:
                rows, times = np.unique(patterns[k], return_counts=True)
                n = int(min(add[k], (left[rows] // times).min()))
                if n > 0 and (add is down or x[k] - down[k] >= 0.5):
                    left[rows] -= n * times
                    out.append((tuple(patterns[k]), n))
        out += best_fit(left, capacity)
    return sorted(out, key=lambda p: (-sum(p[0]), p))


def slots(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (class << 40 | first rank, pieces of the class a sequence, first sequence, first slot), sorted: where ranks of a class go."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, repeats in packed:
        slot = 0
        for n in sorted(set(pattern), reverse=True):
            times = pattern.count(n)
            rows.append(((n << 40) | rank.get(n, 0), times, base, slot))
            rank[n] = rank.get(n, 0) + times * repeats
            slot += times
        base += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _on_a_line(df: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """``df`` with ``at``: the sum of ``size`` over all rows before it, in some order. Cells of rows are summed up first, at most 65,536 of them."""
    cells = min(MOST_CELLS, max(1, math.ceil(rows / CELL_ROWS)))
    df = df.withColumn("cell", F.pmod(F.xxhash64(key), F.lit(cells)))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = df.groupBy("cell").agg(F.sum(size).alias("sum")).select("cell", before.alias("base"))
    within = F.sum(size).over(Window.partitionBy("cell").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return df.withColumn("within", within).join(F.broadcast(bases), "cell").withColumn("at", F.col("base") + F.col("within")).drop("cell", "base", "within")


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(7)]
        for doc, start, total, ids, parts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            for p in parts:
                data = ids[4 * p["from"] : 4 * (p["from"] + p["size"])]
                for column, value in zip(rows, (doc, start + p["from"], p["size"], zlib.crc32(data), total, p["sequence_id"], p["offset"]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=_OUT)


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def stock_pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, classes: int = CLASSES) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of ``docs(doc_id, text, ...)``.

    Null text is empty: the end id alone. Repeated rows are packed as often as they occur; missing ids stay null. An empty table gives no
    rows. Other columns are ignored. The driver gets one row a class and a handful of sums; what it sends out is the patterns, at most a few
    a class. With the reserve larger than the gaps, as in all tables seen, no sequence is padded; a smaller one would leave gaps open.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = min(1.0, max(1 / RESERVE_SHARE, RESERVE_LEAST / max(1, docs.count())))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spare boolean, ids binary"
    made = cut(rows.mapInArrow(_cut_up(path, length, end, share), schema).withColumn("key", F.monotonically_increasing_id()))
    width = -(-length // classes)
    capacity = length // width
    part = made.where((F.col("length") < length) & ~F.col("spare")).drop("ids").withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in part.groupBy("class").count().collect():  # a row a class
        histogram[r["class"]] = r["count"]
    packed = plan(histogram, capacity)
    places, sequences = slots(packed), sum(n for _, n in packed)
    cells = F.element_at(F.array(*(F.lit(max(1, math.ceil(int(h) / CELL_ROWS))) for h in histogram[1:])), F.col("class"))
    part = part.withColumn("cell", F.pmod(F.xxhash64("key"), cells))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = part.groupBy("class", "cell").agg(F.count("*").alias("n")).select("class", "cell", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("class", "cell").orderBy("key")) - 1
    part = part.withColumn("within", within).join(bases, ["class", "cell"]).withColumn("rank", F.col("base") + F.col("within"))

    @F.arrow_udf("sequence_id long, slot long")
    def place(kinds: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = kinds.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False)
        key = (n << 40) | r
        at = places[np.searchsorted(places[:, 0], key, "right") - 1]
        rel = key - at[:, 0]
        return pa.StructArray.from_arrays([pa.array(at[:, 2] + rel // at[:, 1]), pa.array(at[:, 3] + rel % at[:, 1])], names=["sequence_id", "slot"])

    sequence = Window.partitionBy("sequence_id")
    upto = F.sum("length").over(sequence.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("at", place("class", "rank")).select("*", "at.sequence_id", "at.slot").withColumns({"offset": upto - F.col("length"), "used": F.sum("length").over(sequence)})
    part = cut(part.select(*_OUT, "slot", "used"))
    whole = made.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})

    spare = made.where("spare")
    pieces, tokens = spare.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    gaps = part.where((F.col("slot") == 0) & (F.col("used") < length)).select("sequence_id", F.col("used").alias("offset"), (length - F.col("used")).alias("room"))
    open_, room = gaps.agg(F.count("*"), F.coalesce(F.sum("room"), F.lit(0))).first()
    gaps = _on_a_line(gaps, "sequence_id", "room", open_)
    left = max(0, tokens - room)
    new = spark.range(left // length).select((F.lit(sequences) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(length).cast("long").alias("room"), (F.lit(room) + F.col("id") * length).alias("at"))
    last, at = [], room + left // length * length
    for k in range(length.bit_length() - 1, -1, -1):
        if (left % length) >> k & 1:
            last.append((sequences + left // length + len(last), 0, 1 << k, at))
            at += 1 << k
    rooms = gaps.select("sequence_id", "offset", "room", "at").union(new).union(spark.createDataFrame(last, "sequence_id long, offset long, room long, at long"))
    line = _on_a_line(spare.select("key", "length"), "key", "length", pieces).withColumnRenamed("at", "piece_at")
    blocks = lambda a, n: F.explode(F.sequence((F.col(a) / length).cast("long"), ((F.col(a) + F.col(n) - 1) / length).cast("long")))  # noqa: E731  two at most
    both = rooms.withColumn("block", blocks("at", "room")).join(line.withColumn("block", blocks("piece_at", "length")), "block")
    from_, to = F.greatest("at", "piece_at"), F.least(F.col("at") + F.col("room"), F.col("piece_at") + F.col("length"))
    both = both.where((from_ < to) & ((from_ / length).cast("long") == F.col("block")))
    share_of = F.struct((from_ - F.col("piece_at")).alias("from"), (to - from_).alias("size"), "sequence_id", (F.col("offset") + from_ - F.col("at")).alias("offset"))
    shares = both.groupBy("key").agg(F.collect_list(share_of).alias("shares"))  # at most one a token of the piece
    filled = spare.join(shares, "key").select("doc_id", "start", "doc_tokens", "ids", "shares")
    filled = filled.mapInArrow(_fragments, ", ".join(f"{c} long" for c in _OUT))
    return whole.select(*_OUT).union(part.select(*_OUT)).union(filled)
