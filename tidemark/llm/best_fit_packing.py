"""Packing documents into sequences: length patterns fitted to the histogram by non-negative least squares.

Documents become token ids and an end id; longer ones are cut into full pieces, the first of which may be shorter. All
patterns of up to three lengths that fill a sequence exactly are enumerated; repeat counts x >= 0 minimise |A x - histogram|
(accelerated projected gradient), are rounded to whole sequences that the histogram can serve, and the pieces left are packed best
fit, longest first, on the histogram. The histogram has one row a length, so the solve is the same work at any size; pieces find their
places by their rank among pieces of equal length.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

LENGTH, END = 1024, 2
CACHE = 200_000
RANK_CELL = 500
_LOOSE_SPACE = re.compile(r" (?:\s|$)")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Exact ids of the tokenizer file at ``path``.

    The same vocabulary as ranks is several times faster, and so is remembering words: a space that is followed by anything but white
    space always opens a new piece of this byte-level BPE. Texts with special strings, and files without ranks beside them, go
    through the tokenizer itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    plain = lambda text: whole.encode(text, add_special_tokens=False).ids
    try:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(re.sub(r"json$", "tiktoken", path), "rb"))}
        pattern = public_tokenizers.PATTERN
    except (ImportError, FileNotFoundError):
        return plain
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return plain(text)
        if _LOOSE_SPACE.search(text):
            return quick(text)
        first, *rest = text.split(" ")
        ids = quick(first)
        for word in rest:
            got = known.get(word)
            if got is None:
                got = quick(" " + word)
                if len(word) < 40:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = got
            ids += got
        return ids

    return encode


def pieces(ids: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, end) of the pieces: all full but the first."""
    n = len(ids)
    first = n % length or length
    return [(0, min(n, first))] + [(a, a + length) for a in range(first, n, length)]


def _cut_up(path: str, length: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.array(encode(text.as_py() or "") + [end], "<u4")
                for k, (a, b) in enumerate(pieces(tokens, length)):
                    part = tokens[a:b]
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(part.tobytes()), part.astype(np.int64).tolist() if keep_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def exact_patterns(lengths: np.ndarray, total: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``total``, in descending order, from the lengths given."""
    have = np.zeros(total + 1, bool)
    have[lengths] = True
    have[0] = True
    out = []
    for a in lengths[(lengths * 3 >= total) & (lengths < total)]:
        b = np.arange(max(1, -(-(total - a) // 2)), min(a, total - a) + 1)
        c = total - a - b
        ok = have[b] & have[c]
        out.append(np.column_stack([np.full(ok.sum(), a), b[ok], c[ok]]))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the histogram on the patterns."""
    size = len(histogram)
    flat, rows = patterns.ravel(), np.repeat(np.arange(len(patterns)), 3)
    live = flat > 0
    flat, rows = flat[live], rows[live]
    up = lambda x: np.bincount(flat, x[rows], size)
    down = lambda y: np.bincount(rows, y[flat], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(12):
        v = down(up(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * down(up(y) - histogram))
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(histogram: np.ndarray, total: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): longest pieces first, each into the fullest open sequence that takes it; equal ones move together."""
    open_: dict[int, list] = {}
    done = []
    for n in range(len(histogram) - 1, 0, -1):
        left = int(histogram[n])
        while left:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                fit = total // n
                for size, k in ((fit, left // fit), (left % fit, 1)):
                    if size and k:
                        open_.setdefault(total - n * size, []).append(((n,) * size, k))
                left = 0
                break
            pattern, k = open_[room].pop()
            if not open_[room]:
                del open_[room]
            take = min(k, left)
            if take < k:
                open_.setdefault(room, []).append((pattern, k - take))
            open_.setdefault(room - n, []).append(((*pattern, n), take))
            left -= take
        if 0 in open_:
            done += open_.pop(0)
    return done + [x for group in open_.values() for x in group]


def plan(histogram: np.ndarray, total: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that use up ``histogram`` (index: length; full lengths excluded)."""
    left, out = histogram.astype(np.int64).copy(), []
    patterns = exact_patterns(np.flatnonzero(left), total)
    if len(patterns):
        x = fit_counts(patterns, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            n = int(min(math.floor(x[k] + 0.5), (left[lengths] // times).min()))
            if n:
                left[lengths] -= n * times
                out.append((tuple(int(v) for v in patterns[k] if v), n))
    return out + best_fit(left, total)


def _slots(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length << 40 | first rank, pieces of the length a sequence, first sequence, offset), sorted: where ranks of a length go."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for pattern, repeats in packed:
        offset = 0
        for n, times in sorted(((n, pattern.count(n)) for n in set(pattern)), reverse=True):
            rows.append(((n << 40) | rank.get(n, 0), times, base, offset))
            rank[n] = rank.get(n, 0) + times * repeats
            offset += n * times
        base += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) for every piece of ``docs(doc_id, text, ...)``.

    Null text is empty: the end id alone. Repeated rows are packed as often as they occur. An empty table gives no rows. Other
    columns are ignored.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _cut_up(path, length, end, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>"
    )
    made = cut(made.withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # a row a length
    histogram = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        if n < length:
            histogram[n] = c
    slots = _slots(plan(histogram, length))
    full = made.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    part = made.where(F.col("length") < length)
    cells = max(1, math.ceil(max(histogram.max(initial=0), 1) / RANK_CELL))
    part = part.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    sizes = part.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "cell", before.alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1
    part = part.withColumn("within", within).join(sizes, ["length", "cell"]).withColumn("rank", F.col("base") + F.col("within"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        key = (n << 40) | r
        at = slots[np.searchsorted(slots[:, 0], key, "right") - 1]
        rel = key - at[:, 0]
        return pa.StructArray.from_arrays([pa.array(at[:, 2] + rel // at[:, 1]), pa.array(at[:, 3] + rel % at[:, 1] * n)], names=["sequence_id", "offset"])

    part = part.withColumn("at", place("length", "rank")).withColumns({"sequence_id": F.col("at.sequence_id"), "offset": F.col("at.offset")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return full.select(*columns).union(part.select(*columns))
