"""Quality rules on compression: text that zstandard squeezes far too well or hardly at all is rejected.

The ratio (bytes over compressed bytes) of the whole document and of its fixed chunks must lie in a band
that depends on the length: short texts carry frame overhead, long ones gain from repetition. A document
goes when its whole ratio is outside its band or when over ``BAD_CHUNKS`` of its chunks are outside theirs.
The chunks of a text cover all its bytes and are smaller for shorter texts; each has the band of its own length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernel import Words, batches, windows

LEVEL = 3
CHUNK = 2048
#: (texts below this many bytes, bytes of their chunks)
CHUNKS = ((2048, 256), (4096, 512), (float("inf"), CHUNK))
#: (texts below this many bytes, least ratio, greatest ratio)
BANDS = ((256, 0.5, 4.0), (512, 0.9, 3.0), (1024, 1.05, 3.2), (4096, 1.15, 3.5), (16384, 1.25, 4.0), (float("inf"), 1.3, 5.0))
CHUNK_BAND = (1.05, 4.0)
#: The same for chunks, which carry more of the frame. Below ``CHUNK`` bytes good prose of sf0.1 stays 0.08 or more above the least ratio of its length.
CHUNK_BANDS = ((256, 1.0, 3.0), (512, 1.15, 3.0), (1024, 1.25, 3.2), (CHUNK, 1.3, 3.5), (float("inf"), *CHUNK_BAND))
BAD_CHUNKS = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("chunks", pa.int64()),
])
SPARK_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, chunks long"


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    tri = windows(hashes, 3)
    if len(tri) < 2:
        return 0
    order = np.argsort(tri, kind="stable")
    ranked = tri[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(tri), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(hashes), bool)
    for k in range(3):
        mark[k : k + len(tri)] |= twice
    return int(mark.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _within(part: bytes, ratio: float, bands: tuple) -> bool:
    low, high = next((lo, hi) for top, lo, hi in bands if len(part) < top)
    return low <= ratio <= high


def chunks_of(text: bytes) -> list[bytes]:
    """Chunks that cover the text. A rest of half a chunk or more is one itself, a shorter one belongs to the chunk before it."""
    size = next(size for top, size in CHUNKS if len(text) < top)
    count = max(1, (len(text) + size // 2) // size)
    return [text[k * size : (k + 1) * size if k < count - 1 else len(text)] for k in range(count)]


def verdict(text: bytes, squeeze: Callable[[bytes], bytes]) -> tuple[bool, float, int, int]:
    """(within the bands, whole ratio, chunks outside, chunks). No bytes: nothing to reject by ratio."""
    if not text:
        return True, 0.0, 0, 0
    ratio = len(text) / len(squeeze(text))
    whole, parts = _within(text, ratio, BANDS), chunks_of(text)
    # a chunk that is the whole text is judged as that
    bad = sum(not _within(p, len(p) / len(squeeze(p)), CHUNK_BANDS) for p in parts) if len(parts) > 1 else int(not whole)
    return whole and bad <= BAD_CHUNKS * len(parts), ratio, bad, len(parts)


def _slice(words: Words, squeeze: Callable[[bytes], bytes]) -> list[np.ndarray]:
    n = len(words)
    n_words = np.diff(words.first)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[words.offsets])
    points = (words.raw & 0xC0) != 0x80
    blank = (words.raw == 32) | ((words.raw >= 9) & (words.raw <= 13))
    dup, rep, kept, ratio, bad, chunks = (np.zeros(n, kind) for kind in (np.int64, np.int64, bool, float, np.int64, np.int64))
    for d in range(n):
        text = words.text(d)
        dup[d] = duplicate_lines(text)
        rep[d] = repeated_words(words.hash[words.first[d] : words.first[d + 1]])
        kept[d], ratio[d], bad[d], chunks[d] = verdict(text, squeeze)
    failed = (n_words < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n_words)
    return [n_words, sums(points & ~blank), sums(_SYMBOL[words.raw]), dup, rep, failed, kept & ~failed, ratio, bad, chunks]


def measure(column: pa.Array) -> pa.StructArray:
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    parts = [_slice(words, squeeze) for _, _, words in batches(column, exact=True)]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, FIELDS, strict=True)], fields=list(FIELDS))


def with_compression_verdict(docs: DataFrame, column: str = "verdict", text: str = "text") -> DataFrame:
    """``docs`` with a struct of the counts and the verdict. Null text counts as empty; empty text has no words
    and so fails. Rows are judged one by one, so ties, repeats and further columns change nothing."""

    @F.arrow_udf(SPARK_FIELDS)
    def judge(texts: pa.Array) -> pa.Array:
        return measure(texts)

    return docs.withColumn(column, judge.asNondeterministic()(F.col(text).cast("string")))
