"""Questions met with blocks of entries inside the tasks that read them: what leaves a task is the first few entries of each question, never all its matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Cells of a block's table of tokens by entries.
CELLS = 1 << 22
#: Entries of a task's first block, which only finds scores to reach, how much larger each next one is, and the most entries and occurrences of a block.
FIRST_BLOCK, GROWTH, BLOCK_ROWS, BLOCK_OCCURRENCES = 512, 4, 16384, 8_000_000
#: So few rows are summed up whole, not token by token.
FEW = 64
#: A score that falls short of the least by no more than this may still reach it when rounded.
SLACK = 2e-6
FOUND = "kind string, question_id long, token string, entry_id long, place_by double, value double"


@dataclass
class Asked:
    """The tokens of some questions: codes are places in ``vocabulary``."""

    vocabulary: pa.Array
    questions: np.ndarray
    codes: list[np.ndarray]  # of each question
    weights: list[np.ndarray]  # times and inverse frequency, as the codes
    words: list[np.ndarray]  # codes of the words

    @staticmethod
    def of(rows: pa.Table) -> Asked:
        """From ``question_id, token, word, weight``."""
        tokens = rows.column("token").combine_chunks().dictionary_encode()
        code, question = tokens.indices.to_numpy(zero_copy_only=False), rows.column("question_id").to_numpy()
        weight, word = rows.column("weight").to_numpy(), rows.column("word").to_numpy()
        order = np.lexsort((code, question))
        begin = np.flatnonzero(np.diff(question[order], prepend=question[order][:1] - 1))
        parts = np.split(order, begin[1:]) if len(order) else []
        return Asked(tokens.dictionary, question[order][begin], [code[p] for p in parts], [weight[p] for p in parts], [code[p][word[p]] for p in parts])


class Firsts:
    """The first ``n`` rows of every key: highest ``by`` first, equal ones by entry."""

    def __init__(self, n: int) -> None:
        self.n, self.rows = n, {}

    def add(self, key: int, by: np.ndarray, entry: np.ndarray, value: np.ndarray) -> None:
        new = np.stack([by, value]), entry
        had, least = self.rows.get(key), self.least(key)
        if len(by) > self.n:
            least = max(least, np.partition(by, -self.n)[-self.n])
        stays = by >= least
        if not stays.any():
            return
        new = new[0][:, stays], new[1][stays]
        if had is not None:
            new = np.concatenate([had[0], new[0]], axis=1), np.concatenate([had[1], new[1]])
        order = np.lexsort((new[1], -new[0][0]))[: self.n]
        self.rows[key] = new[0][:, order], new[1][order]

    def least(self, key: int) -> float:
        """What a row must reach to be among the first."""
        had = self.rows.get(key)
        return had[0][0, -1] if had is not None and len(had[1]) == self.n else -np.inf

    def batches(self, kind: str, asked: Asked, by_token: bool = False) -> Iterator[pa.RecordBatch]:
        for key, (numbers, entry) in self.rows.items():
            question, token = (None, asked.vocabulary[key].as_py()) if by_token else (int(asked.questions[key]), None)
            n = len(entry)
            columns = [pa.array([kind] * n), pa.array([question] * n, pa.int64()), pa.array([token] * n, pa.string()), pa.array(entry), pa.array(numbers[0]), pa.array(numbers[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "question_id", "token", "entry_id", "place_by", "value"])


def occurrences(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, code, tf, dl`` of each part of the entries of a batch (entry_id, created_at, parts) that holds a token of the vocabulary."""
    parts = batch.column(2)
    flat = parts.flatten()
    row = np.repeat(np.arange(len(batch)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    lists = flat.field("tokens")
    part = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    code = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    hit = code >= 0
    key, tf = np.unique(part[hit] * len(vocabulary) + code[hit], return_counts=True)
    part, code = np.divmod(key, max(1, len(vocabulary)))
    return row[part], code, tf, flat.field("dl").to_numpy(zero_copy_only=False)[part]


def frequencies(rows: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """How many parts of entries hold each token; a row a token comes back."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            n += np.bincount(occurrences(batch, sent.value)[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["code", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in rows.mapInArrow(count, "code long, n long").groupBy("code").sum("n").collect():
        out[r[0]] = r[1]
    return out


class Block:
    """Entries of one text each as posting lists: of each token the rows that hold it, in order, how often, and what that adds to a score."""

    def __init__(self, entry: np.ndarray, created: np.ndarray, dl: np.ndarray, row: np.ndarray, code: np.ndarray, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        self.entry, self.created = entry, created
        self.key, self.tf = np.unique(code.astype(np.int64) * len(entry) + row, return_counts=True)
        code, row = np.divmod(self.key, max(1, len(entry)))
        self.rows = row.astype(np.int32)
        self.starts = np.searchsorted(code, np.arange(size + 1))
        self.lengths = np.diff(self.starts)
        self.there = np.flatnonzero(self.lengths)
        self.parts, self.highest = None, np.zeros(size)
        if part is not None:
            self.parts = part(self.tf, dl[row])
            if len(self.there):
                self.highest[self.there] = np.maximum.reduceat(self.parts, self.starts[self.there])

    def held(self, code: int) -> slice:
        return slice(self.starts[code], self.starts[code + 1])

    def met(self, code: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``rows`` hold a token, and the places of these in its list."""
        own = self.rows[self.held(code)]
        at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        here = own[at] == rows
        return here, at[here] + self.starts[code]

    def sums(self, codes: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The whole sums of some rows, added in one order for all, so that equal texts are equal to the last digit."""
        wanted = codes[:, None] * np.int64(len(self.entry)) + rows
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return (np.where(self.key[at] == wanted, self.parts[at], 0.0) * weights[:, None]).sum(axis=0)

    def holding(self, words: np.ndarray) -> np.ndarray:
        """Rows that hold every word: those of the rarest one, of which each further word leaves some."""
        words = words[np.argsort(self.lengths[words], kind="stable")]
        rows = self.rows[self.held(words[0])]
        for word in words[1:]:
            if not len(rows):
                break
            rows = rows[self.met(word, rows)[0]]
        return rows

    def reaching(self, codes: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose sum of weight times part may reach ``least``, and their sums.

        Tokens that together cannot reach it are only looked up, in the rows that hold one of the others, as long as the rest may lift these to it.
        """
        live = self.lengths[codes] > 0
        codes, weights = codes[live], weights[live]
        most = weights * self.highest[codes]
        order = np.argsort(most)
        upto = most[order].cumsum()
        looked_up = int(np.searchsorted(upto, least - SLACK))
        if looked_up == len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        lists = [(k, self.held(codes[k])) for k in order[looked_up:]]
        sums = np.bincount(np.concatenate([self.rows[x] for _, x in lists]), np.concatenate([weights[k] * self.parts[x] for k, x in lists]), len(self.entry))
        rows = np.flatnonzero(sums >= max(least - SLACK - (upto[looked_up - 1] if looked_up else 0.0), np.nextafter(0, 1)))
        some = sums[rows]
        for k in range(looked_up - 1, -1, -1):
            if len(rows) <= FEW:
                break
            here, at = self.met(codes[order[k]], rows)
            some[here] += weights[order[k]] * self.parts[at]
            stays = some + (upto[k - 1] if k else 0.0) >= least - SLACK
            rows, some = rows[stays], some[stays]
        if not len(rows):
            return rows, some
        some = self.sums(codes, weights, rows)
        stays = some >= least - SLACK
        return rows[stays], some[stays]


class Blocks:
    """Entries gathered to blocks that grow from FIRST_BLOCK entries on; the texts themselves are not kept."""

    def __init__(self, vocabulary: pa.Array, part: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        self.vocabulary, self.part, self.most, self.held, self.n, self.occurrences = vocabulary, part, FIRST_BLOCK, [], 0, 0

    def add(self, batch: pa.RecordBatch) -> Iterator[Block]:
        while len(batch):
            some, batch = batch.slice(0, self.most - self.n), batch.slice(self.most - self.n)
            texts = some.column(2).flatten()
            lists = texts.field("tokens")
            code = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(self.n, self.n + len(some), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            hit = code >= 0
            self.held.append((some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_numpy(zero_copy_only=False), texts.field("dl").to_numpy(zero_copy_only=False), row[hit], code[hit].astype(np.int32)))
            self.n += len(some)
            self.occurrences += int(hit.sum())
            if self.n == self.most or self.occurrences >= BLOCK_OCCURRENCES:
                yield self.rest()
                self.most = min(BLOCK_ROWS, self.most * GROWTH)

    def rest(self) -> Block:
        columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        self.held, self.n, self.occurrences = [], 0, 0
        return Block(*columns, len(self.vocabulary), self.part)


def _add_repeated(kept: dict[str, Firsts], a: Asked, block: pa.RecordBatch, is_word: np.ndarray, part: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
    """Entries of several texts, by a whole table of tokens by entries: a word counts once for each text that holds it."""
    size = len(a.vocabulary)
    entry, created = (block.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    row, code, tf, dl = occurrences(block, a.vocabulary)
    held, times = np.zeros((size, len(block)), np.uint8), np.zeros((size, len(block)), np.int32)
    np.add.at(held, (code, row), 1)
    np.add.at(times, (code, row), tf)
    if "best" in kept:
        parts = np.zeros((size, len(block)))
        np.add.at(parts, (code, row), part(tf, dl))
    for q, words in enumerate(a.words):
        if "best" in kept:
            raw = a.weights[q] @ parts[a.codes[q]]
            at = np.flatnonzero(raw > 0)
            kept["best"].add(q, np.round(raw[at], 6), entry[at], raw[at])
        if len(words) and ("newest" in kept or "holding" in kept):
            at = np.flatnonzero(held[words].sum(axis=0, dtype=np.int64) == len(words))
            if "newest" in kept and len(at):
                kept["newest"].add(q, created[at].astype(float), entry[at], np.zeros(len(at)))
            if "holding" in kept and len(at):
                kept["holding"].add(q, times[np.ix_(words, at)].sum(axis=0).astype(float), entry[at], np.zeros(len(at)))
    if "most" in kept:
        order = np.argsort(code, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
            if is_word[code[at[0]]]:
                kept["most"].add(int(code[at[0]]), tf[at].astype(float), entry[row[at]], np.zeros(len(at)))


def _add(kept: dict[str, Firsts], a: Asked, block: Block, is_word: np.ndarray) -> None:
    """What the entries of a block add to the first ones of all questions."""
    if "best" in kept:
        for q, codes in enumerate(a.codes):
            rows, raw = block.reaching(codes, a.weights[q], kept["best"].least(q))
            if len(rows):
                kept["best"].add(q, np.round(raw, 6), block.entry[rows], raw)
    if "newest" in kept or "holding" in kept:
        for q, words in enumerate(a.words):
            if not len(words) or not block.lengths[words].all():
                continue
            rows = block.holding(words)
            if not len(rows):
                continue
            nothing = np.zeros(len(rows))
            if "newest" in kept:
                kept["newest"].add(q, block.created[rows].astype(float), block.entry[rows], nothing)
            if "holding" in kept:
                times = sum(block.tf[block.met(word, rows)[1]] for word in words)
                kept["holding"].add(q, times.astype(float), block.entry[rows], nothing)
    if "most" in kept:
        firsts = kept["most"]
        least, last = np.full(len(is_word), -1.0), np.zeros(len(is_word), np.int64)  # of each word: what its last row so far has
        for code, (numbers, entry) in firsts.rows.items():
            if len(entry) == firsts.n:
                least[code], last[code] = numbers[0, -1], entry[-1]
        least[~is_word] = np.inf
        code = np.repeat(block.there, block.lengths[block.there])
        at = np.flatnonzero(block.tf >= least[code])
        code, entry, tf = code[at], block.entry[block.rows[at]], block.tf[at].astype(float)
        ahead = (tf > least[code]) | (entry < last[code])
        code, entry, tf = code[ahead], entry[ahead], tf[ahead]
        edges = np.flatnonzero(np.diff(code, prepend=-1, append=-1)) if len(code) else []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            firsts.add(int(code[x]), tf[x:y], entry[x:y], np.zeros(y - x))


def first_found(rows: DataFrame, asked: Asked, part: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, newest: int = 0, most: int = 0, best: int = 0, holding: int = 0) -> DataFrame:
    """``kind, question_id, token, entry_id, place_by, value`` of ``rows(entry_id, created_at, parts)``, at least the first so many of each question or token.

    ``best``: by the sum of weight times ``part(tf, dl)``, to six digits; the sum is the value. ``newest``: of the entries that hold every word, by time. ``holding``: of those, by
    occurrences of the words. ``most``: of each word, by its occurrences. Every task gives its own first ones.
    """
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        size = len(a.vocabulary)
        kept = {kind: Firsts(n) for kind, n in (("best", best), ("newest", newest), ("most", most), ("holding", holding)) if n}
        is_word = np.zeros(size, bool)
        for words in a.words:
            is_word[words] = True
        width = max(64, min(4096, CELLS // max(1, size)))
        blocks = Blocks(a.vocabulary, part if best else None)
        for batch in batches:
            repeated = pc.greater(pc.list_value_length(batch.column(2)), 1)
            for block in blocks.add(batch.filter(pc.invert(repeated))):
                _add(kept, a, block, is_word)
            batch = batch.filter(repeated)
            for k in range(0, len(batch), width):
                _add_repeated(kept, a, batch.slice(k, width), is_word, part)
        if blocks.held:
            _add(kept, a, blocks.rest(), is_word)
        for kind, firsts in kept.items():
            yield from firsts.batches(kind, a, by_token=kind == "most")

    # as many tasks as the cluster runs, whatever the input, so that what leaves them grows with the questions alone
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, FOUND)
