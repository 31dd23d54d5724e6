"""Vectorised word splitting and hashing of Arrow text columns.

A whole Arrow batch is tokenised at once with numpy: words are the maximal runs of
bytes outside ``\\x20`` and ``\\x09-\\x0D`` (the contract's ``[^\\x20\\x09-\\x0D]+``), with
A-Z lower-cased before hashing. Work is cut into slices of bounded bytes, so memory
depends on the slice (or on the longest single text), never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """Words of a slice of documents; ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray  # lower-cased bytes of all texts
    raw: np.ndarray  # bytes as given
    offsets: np.ndarray  # text d is data[offsets[d]:offsets[d + 1]]
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, d: int) -> bytes:
        return self.raw[self.offsets[d] : self.offsets[d + 1]].tobytes()

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = min(n, max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1))
        yield row, stop, body[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def words_of(raw: np.ndarray, offsets: np.ndarray, exact: bool = False) -> Words:
    """``exact``: words keep their case."""
    size = len(raw)
    data = raw if exact else _LOWER[raw]
    inside = ~_SPACE[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    room = 1 << max(16, int(size).bit_length())
    up, down = _powers(room)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:size], out=total[1:])
    code = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407)
    first = np.searchsorted(start, offsets)
    return Words(data, raw, offsets, start, end, mix(code), first)


def batches(column: pa.Array, limit: int = SLICE_BYTES, exact: bool = False) -> Iterator[tuple[int, int, Words]]:
    for row, stop, raw, offsets in slices(column, limit):
        yield row, stop, words_of(raw, offsets, exact)


_STEP = mix(np.arange(1, 9, dtype=np.uint64)) | _U(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size * 0x8CB92BA72F3D8DD7 % 2**64, np.uint64)
    for k in range(size):
        out += hashes[k : n + k] * _STEP[k]
    return mix(out)


def shingle_set(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle; no words, none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(size, len(hashes))))
