"""Texts as streams of bits: the code of frequent words, the bytes of new ones, and what a text has said before."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tidemark.llm.bit_mixer import place
from tidemark.llm.textkernel import _BYTE_CODE, Words, _powers, mix

_U = np.uint64
CLOSE = 32  # a space cannot stand in a word, so it closes one; alone it is the end of the text
END_HASH = int(mix(np.array([0x1D8E4E27C47D124F], _U))[0])
START = mix(np.array([0x3C79AC492BA7B653, 0x1C69B3F74AC4AE35], _U))
#: log2 of the counter pairs: of the code without context, after the last two coded words and the word before, after the last coded word.
WORD_BITS = (14, 22, 21)
#: The same within new words: place, two and three bytes back, the whole word so far.
BYTE_BITS = (10, 18, 20, 20)
SEEK_BITS = 21


@dataclass
class Code:
    """A prefix code of the most frequent words, most frequent first, and one sign for all other words."""

    keys: np.ndarray  # hashes of the words with a price at hand; the first ``coded`` have a sign of their own
    coded: int
    node: np.ndarray
    bit: np.ndarray
    first: np.ndarray  # by sign: where its path begins
    size: np.ndarray

    def __post_init__(self) -> None:
        self.seek = np.full(1 << SEEK_BITS, -1, np.int32)
        at = (self.keys >> _U(64 - SEEK_BITS)).astype(np.int64)
        self.seek[at[::-1]] = np.arange(len(at) - 1, -1, -1)  # the more frequent one of two stays

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each word in ``keys``, -1 for others."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = self.seek.take((h >> _U(64 - SEEK_BITS)).astype(np.int64))
        return np.where(self.keys.take(np.maximum(at, 0)) == h, at, -1).astype(np.int64)


def settled(keys: np.ndarray) -> np.ndarray:
    """Which of the words, most frequent first, can be found: those whose seat no more frequent word has."""
    seats = keys >> _U(64 - SEEK_BITS)
    first = np.zeros(len(keys), bool)
    first[np.unique(seats, return_index=True)[1]] = True
    return first


def code_of(keys: np.ndarray, counts: np.ndarray, coded: int, rest: float) -> Code:
    """Huffman code of the first ``coded`` of ``keys`` by their counts; ``rest`` stands for all other words."""
    weights = [*counts[:coded].tolist(), max(1.0, rest)]
    heap = [(w, k, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    up, n = {}, len(weights)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, n, n))
        n += 1
    nodes, bits, sizes = [], [], []
    for k in range(len(weights)):
        path, at = [], k
        while at in up:
            at, b = up[at]
            path.append((n - 1 - at, b))  # the root is node 0
        sizes.append(len(path))
        nodes += [x for x, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    size = np.array(sizes, np.int64)
    return Code(keys, coded, np.array(nodes, np.int64), np.array(bits, np.uint8), np.cumsum(size) - size, size)


@dataclass
class Tokens:
    """The tokens of a slice of texts, ends included."""

    hash: np.ndarray
    owner: np.ndarray
    first: np.ndarray  # text d is first[d]:first[d + 1]
    where: np.ndarray  # place of each token in its text
    index: np.ndarray  # in the keys of the code
    sign: np.ndarray


def tokens_of(words: Words, code: Code) -> Tokens:
    n = len(words)
    h = np.insert(words.hash, words.first[1:], _U(END_HASH))
    first = words.first + np.arange(n + 1)
    sizes = np.diff(first)
    index = code.find(h)
    sign = np.where((index >= 0) & (index < code.coded), index, code.coded)
    return Tokens(h, np.repeat(np.arange(n), sizes), first, np.arange(len(h)) - np.repeat(first[:-1], sizes), index, sign)


#: Tokens whose bits are laid out at a time, so that memory does not follow the longest text.
PIECE = 1 << 16


def word_bits(t: Tokens, code: Code, take: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(token, bit, slots, depth class) of every bit of the signs, in pieces; ``take``: of these tokens only.

    Contexts: none; the last two coded words with the word before; the last coded word.
    """
    n = len(t.hash)
    last = np.maximum.accumulate(np.where(t.sign < code.coded, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    ever = np.concatenate([[-1], last[:-1]])[:n]  # the last coded word before this token
    ever = np.where(ever >= t.first[t.owner], ever, -1)
    one = np.where(ever >= 0, t.hash.take(np.maximum(ever, 0)), START[0])
    two = np.where(ever >= 0, one.take(np.maximum(ever, 0)), START[1])
    contexts = [mix(one + two * _U(0x2545F4914F6CDD1D) + before(t) * _U(3)), one]
    picked = np.arange(n) if take is None else np.flatnonzero(take)
    for k in range(0, len(picked), PIECE):
        pick = picked[k : k + PIECE]
        sizes = code.size.take(t.sign[pick])
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(code.first.take(t.sign[pick]), sizes) + inner
        node = code.node.take(at)
        slots = [place(None, node, WORD_BITS[0])] + [place(np.repeat(c[pick], sizes), node, b) for c, b in zip(contexts, WORD_BITS[1:], strict=True)]
        yield np.repeat(pick, sizes), code.bit.take(at), slots, np.minimum(inner, 4) // 2


def before(t: Tokens) -> np.ndarray:
    """Hash of the word before each token; a fixed value at the start of a text."""
    out = np.empty_like(t.hash)
    out[1:] = t.hash[:-1]
    out[t.where == 0] = START[0]
    return out


def byte_bits(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(word, bit, slots, place class) of every bit of the words of a binary column, each closed; the empty word is the end of a text."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    value = np.full(len(body) + n, CLOSE, np.uint8)
    first, sizes = ends[:-1] + np.arange(n), np.diff(ends) + 1
    inner = np.ones(len(value), bool)
    inner[ends[1:] + np.arange(n)] = False
    value[inner] = body
    where = np.arange(len(value)) - np.repeat(first, sizes)
    past = np.zeros((3, len(value)), _U)
    for k in (1, 2, 3):
        past[k - 1, k:] = value[:-k]
        past[k - 1, where < k] = 0
    up, down = _powers(1 << max(16, int(len(value)).bit_length()))
    total = np.zeros(len(value) + 1, _U)
    np.cumsum(_BYTE_CODE[value] * up[: len(value)], out=total[1:])
    begin = np.arange(len(value)) - where
    prefix = mix((total[:-1] - total[begin]) * down[begin] + where.astype(_U))
    two = past[0] | past[1] << _U(8)
    contexts = [mix(two + _U(1 << 40)), mix((two | past[2] << _U(16)) + _U(1 << 41)), prefix]
    k = np.arange(8)
    node = ((1 << k)[None, :] | (value[:, None].astype(np.int64) >> (8 - k)[None, :])).reshape(-1)
    bit = ((value[:, None] >> (7 - k).astype(np.uint8)[None, :]) & 1).astype(np.uint8).reshape(-1)
    slots = [np.repeat(np.minimum(where, 3), 8) * 256 + node] + [place(np.repeat(c, 8), node, b) for c, b in zip(contexts, BYTE_BITS[1:], strict=True)]
    return np.repeat(np.repeat(np.arange(n), sizes), 8), bit, slots, np.repeat(np.minimum(where, 2), 8)


def ranked(keys: np.ndarray) -> np.ndarray:
    """A stable order of 64-bit hashes. Places are packed below the upper bits of the hash, so that plain values are sorted."""
    n = len(keys)
    low = _U((1 << max(1, n.bit_length())) - 1)
    order = (np.sort((keys & ~low) | np.arange(n, dtype=_U)) & low).astype(np.int64)
    ordered = keys[order]
    if ((ordered[1:] != ordered[:-1]) & ((ordered[1:] & ~low) == (ordered[:-1] & ~low))).any():
        return np.argsort(keys, kind="stable")  # two hashes agree in the upper bits
    return order


def earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many equal keys come before each, order by key, where its runs begin)."""
    order = ranked(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(fresh)
    run = np.repeat(begin, np.diff(np.append(begin, len(keys))))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - run
    return out, order, begin
