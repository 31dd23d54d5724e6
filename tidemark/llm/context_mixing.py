"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are token sequences: lower-cased words, then one end. Every token is coded as bits. The ``CODED`` most frequent words have a prefix code,
all others share one sign of it. Each bit of the code is predicted in order from contexts that reach over words (none; the last coded word; the
last two with the word before), whose counters sit in hashed tables; gated weights mix them and an adaptive map refines the mix (``bit_mixer``). A word
behind the shared sign is priced by its count, less a discount; the discounts are what new words get, which a second mixer spells bit by bit
from contexts within the word. So a text's probability is that of all its bits, given all that came before.

A text then adapts as it goes: the price of a token, taken as so many tokens, is weighed against how often this text has said it, and that again
against how often it has said it after the same word; several such strengths are averaged for each text. The last predictor has the whole text as
context: with the odds that training texts are copies, a text is one that the other training texts hold.

Spark gathers everything: the counts of all words, the counters of all bits of all training texts (tables of fixed size, summed block by block, one
block at a time), the sums of what every task learned online. Every token of every training text is counted and teaches the weights. Frequent words are priced from a broadcast of at most ``HOT`` rows, all others by a join on their hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bit_mixer import Lesson, Mixer, combined, packed
from tidemark.llm.common import cut, fold
from tidemark.llm.textkernel import Words, batches, mix
from tidemark.llm.word_code import BYTE_BITS, END_HASH, START, WORD_BITS, Code, before, byte_bits, code_of, earlier, ranked, settled, tokens_of, word_bits

HOT, CODED = 1 << 17, 4000
BLOCK = 1 << 15  # counters that travel together
FLUSH = 2_000_000
SLICE_TEXT, SLICE_WORDS = 1 << 18, 8_000
#: In-text adaptation: (tokens that the price of a word counts as, the same for a word after a word); equal odds for each pair.
STRENGTHS = tuple((a, b) for a in (300.0, 3000.0, 1e6) for b in (3.0, 1e6))
LOG10_2, LOG10_E = float(np.log10(2.0)), float(np.log10(np.e))

# ---- counts of words ----


def _bytes_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as a binary array."""
    sizes = end - start
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(int(ends[-1])) + np.repeat(start - ends[:-1], sizes)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at])])


def _count_words(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, all, train) of the words of (text, in_training), summed before they leave the task."""
    parts: list[tuple] = []

    def summed() -> pa.RecordBatch:
        h = np.concatenate([p[0] for p in parts])
        order = ranked(h)
        begin = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        every, train = (np.add.reduceat(np.concatenate([p[k] for p in parts])[order], begin) for k in (2, 3))
        words = pa.chunked_array([p[1] for p in parts]).take(pa.array(order[begin])).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(h[order[begin]].view(np.int64)), words.cast(pa.binary()), pa.array(every), pa.array(train)], names=["h", "word", "n_all", "n_train"])

    for batch in batches_in:
        learn_from = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, stop, w in batches(batch.column(0)):
            if len(w.hash):
                order = ranked(w.hash)
                begin = np.flatnonzero(np.concatenate([[True], w.hash[order][1:] != w.hash[order][:-1]]))
                inside = np.repeat(learn_from[row:stop], np.diff(w.first))[order]
                at = order[begin]
                parts.append((w.hash[at], _bytes_at(w.data, w.start[at], w.end[at]), np.diff(np.append(begin, len(order))), np.add.reduceat(inside, begin)))
            parts.append((np.array([END_HASH], np.uint64), pa.array([b""], pa.large_binary()), np.array([stop - row]), learn_from[row:stop].sum(keepdims=True)))
        if sum(len(p[0]) for p in parts) > FLUSH:
            yield summed()
            parts = []
    if parts:
        yield summed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``h, word, n_all, n_train`` of every distinct token of ``docs(text, learn)``."""
    counted = docs.select(F.col("text").cast("string").alias("text"), "learn").mapInArrow(_count_words, "h long, word binary, n_all long, n_train long")
    return counted.groupBy("h").agg(F.min("word").alias("word"), F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


# ---- counters and lessons, over all tasks ----

Bits = tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]


def _count_bits(bits: tuple[int, ...], stream: Callable[[pa.RecordBatch], Iterator[Bits]]):
    """The counters of a task as compressed blocks."""
    starts = np.concatenate([[0], np.cumsum([2 << b for b in bits])])

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches_in:
            for _, bit, slots, _ in stream(batch):
                counts = np.zeros(-(-starts[-1] // BLOCK) * BLOCK, np.uint32) if counts is None else counts
                one = np.ones(len(bit), np.uint32)
                for at, start in zip(slots, starts, strict=False):
                    np.add.at(counts, 2 * at + bit + start, one)
        press = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, 0 if counts is None else len(counts), BLOCK):
            block = counts[k : k + BLOCK]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([press(block.tobytes())], pa.binary())], names=["begin", "counts"])

    return run


def _sum_blocks(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come in order of their place: one sum is held at a time. Pairs leave packed, compressed again."""
    opened, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    key, total = None, np.zeros(BLOCK, np.uint64)

    def done() -> pa.RecordBatch:
        pairs = packed(total[0::2]).astype(np.uint16) * np.uint16(256) + packed(total[1::2])
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([press(pairs.tobytes())], pa.binary())], names=["begin", "pairs"])

    for batch in batches_in:
        for begin, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if begin != key:
                if key is not None:
                    yield done()
                key, total = begin, np.zeros(BLOCK, np.uint64)
            total += np.frombuffer(opened(part.as_py()), np.uint32)
    if key is not None:
        yield done()


def counted(source: DataFrame, bits: tuple[int, ...], stream) -> list[np.ndarray]:
    """Counter pairs of all bits of ``source``; the tables are of fixed size, whatever the corpus."""
    starts = np.concatenate([[0], np.cumsum([1 << b for b in bits])])
    table = np.zeros(-(-2 * starts[-1] // BLOCK) * BLOCK // 2, np.uint16)
    blocks = source.mapInArrow(_count_bits(bits, stream), "begin long, counts binary").repartition("begin").sortWithinPartitions("begin")
    for r in blocks.mapInArrow(_sum_blocks, "begin long, pairs binary").collect():
        table[r["begin"] // 2 : r["begin"] // 2 + BLOCK // 2] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["pairs"])), np.uint16)
    return [table[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def learned(source: DataFrame, bits: tuple[int, ...], pairs: list[np.ndarray], stream) -> Mixer:
    """Every task learns online on its part; what comes back is of fixed size."""
    sent = source.sparkSession.sparkContext.broadcast(pairs)

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lesson = None
        for batch in batches_in:
            for _, bit, slots, base in stream(batch):
                lesson = Lesson(Mixer(bits, pairs=list(sent.value))) if lesson is None else lesson
                lesson.learn(slots, bit, base)
        if lesson is not None:
            parts = lesson.sums()
            yield pa.RecordBatch.from_arrays(
                [pa.array([0, 1, 2], pa.int32())] + [pa.array([p[k].tolist() for p in parts], pa.list_(pa.float64())) for k in (0, 1)], names=["part", "a", "b"]
            )

    sums = source.mapInArrow(run, "part int, a array<double>, b array<double>")
    sums = sums.select("part", F.posexplode(F.arrays_zip("a", "b")).alias("place", "x")).groupBy("part", "place").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    whole = Mixer(bits, pairs=pairs)
    empty = Lesson(whole).sums()
    got = [(np.zeros(len(a)), np.zeros(len(a))) for a, _ in empty]
    for r in sums.collect():
        got[r["part"]][0][r["place"]], got[r["part"]][1][r["place"]] = r["a"], r["b"]
    return combined(whole, got)


# ---- the two streams of bits ----


def _text_stream(sent, every: int = 1):
    def run(batch: pa.RecordBatch) -> Iterator[Bits]:
        code = sent.value
        for _, _, w in batches(batch.column(0), SLICE_TEXT):
            t = tokens_of(w, code)
            take = None if every == 1 else mix(t.hash + t.where.astype(np.uint64)) % np.uint64(every) == 0
            yield from word_bits(t, code, take)

    return run


def _word_stream(batch: pa.RecordBatch) -> Iterator[Bits]:
    for k in range(0, len(batch), SLICE_WORDS):
        yield byte_bits(batch.column(0).slice(k, SLICE_WORDS))


def _spelled(speller: Mixer, words: pa.Array) -> np.ndarray:
    """Natural logarithm of the probability of each word."""
    out = []
    for k in range(0, len(words), SLICE_WORDS):
        part = words.slice(k, SLICE_WORDS)
        word, bit, slots, base = byte_bits(part)
        out.append(np.bincount(word, speller.cost(slots, bit, base), len(part)))
    return np.concatenate(out) if out else np.zeros(0)


# ---- scores ----


def said(w: Words, code: Code, mixer: Mixer, price: np.ndarray):
    """The tokens and, for each text, the ln of its probability, but for the prices of the words that are not at hand.

    ``price``: ln of the chance, among words without a sign, of each key (0 for coded ones).
    """
    t = tokens_of(w, code)
    static = np.zeros(len(t.hash))
    for token, bit, slots, base in word_bits(t, code):
        static += np.bincount(token, mixer.cost(slots, bit, base), len(static))
    static = np.exp(static)
    own = t.hash + mix(t.owner.astype(np.uint64) + np.uint64(77))
    again, order, begin = earlier(own)
    after = earlier(mix(own + before(t) * np.uint64(5)))[0]
    met = np.where(t.where > 0, np.concatenate([[0], again[:-1]]), 0)
    away = t.index < 0
    chance = static * np.exp(np.where(away, 0.0, price.take(np.maximum(t.index, 0)) if len(price) else 0.0))
    totals = []
    for a, b in STRENGTHS:
        # a word that is not at hand is priced later, once: when it comes again only its earlier uses count
        x = np.where(away & (again > 0), again, a * chance + again) / (a + t.where)
        totals.append(np.bincount(t.owner, np.log((b * x + after) / (b + met)), len(w)))
    return t, order, begin, np.logaddexp.reduce(np.stack(totals), axis=0) - np.log(len(totals))


def _lookup(sent_code, sent):
    """Sums over the words at hand of each text, and the other words as (hash, times)."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, (base, price, parts) = sent_code.value, sent.value
        mixer = Mixer(*parts)
        for batch in batches_in:
            for row, stop, w in batches(batch.column(3), SLICE_TEXT):
                n = stop - row
                t, order, begin, total = said(w, code, mixer, price)
                near = t.index >= 0
                of, at = t.owner[near], t.index[near]
                begin, times = begin[~near[order[begin]]], np.diff(np.append(begin, len(order)))[~near[order[begin]]]
                far = order[begin]
                seat = np.argsort(t.owner[far], kind="stable")
                items = pa.StructArray.from_arrays([pa.array(t.hash[far][seat].view(np.int64)), pa.array(times[seat].astype(np.int32))], names=["h", "times"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(t.owner[far], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(row, n) for k in range(3)]
                    + [pa.array(np.diff(w.offsets).astype(np.int64)), pa.array(np.diff(t.first).astype(np.int64)), pa.array(np.bincount(of, minlength=n)), pa.array(np.bincount(of, base[at], n).astype(float)), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), items)],
                    names=["row", "doc_id", "sig", "n_bytes", "n_tokens", "n_known", "base_score", "total", "rare"],
                )

    return run


def _hot_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and training counts of the most frequent words: whole count classes from the top, at most HOT rows."""
    grade = F.floor(F.log2("n_train") * 32)
    live = words.where("n_train > 0")
    room, least = HOT, None
    for g, n in sorted(live.groupBy(grade.alias("grade")).count().collect(), reverse=True):  # a row for each step of the logarithm
        room -= n
        if room < 0:
            break
        least = g
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    top = live.where(grade >= least).select("h", "n_train").toPandas()
    keys, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n_train"].to_numpy(float)
    order = np.lexsort((keys, -n))
    keys, n = keys[order], n[order]
    stays = settled(keys)
    return keys[stays], n[stays]


def context_mixing_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts are their end alone; their bits per byte are null. Repeated rows count as often as they occur. An empty table gives no rows; without training
    rows every count is 0 and the untrained model scores. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    learn = fold(F.col("doc_id")) != 1
    words = cut(vocabulary(docs.withColumn("learn", learn)))
    tokens, distinct, once = (x or 0 for x in words.agg(F.sum("n_train"), F.sum((F.col("n_train") > 0).cast("long")), F.sum((F.col("n_train") == 1).cast("long"))).first())
    keys, n = _hot_words(words)
    coded = min(CODED, len(keys))
    rest = float(tokens - n[:coded].sum())
    code = code_of(keys, n, coded, rest)
    training = docs.where(learn).select(F.coalesce("text", F.lit("")).alias("text"))
    sent_code = spark.sparkContext.broadcast(code)  # at most HOT words
    pairs = counted(training, WORD_BITS, _text_stream(sent_code))
    mixer = learned(training, WORD_BITS, pairs, _text_stream(sent_code))
    # new words look like those seen once
    single = words.where("n_train = 1").select("word")
    pairs = counted(single, BYTE_BITS, _word_stream)
    speller = learned(single, BYTE_BITS, pairs, _word_stream)

    # words without a sign: their count less a discount, and all discounts are for new words
    kinds = distinct - coded
    discount = min(0.95, max(0.05, once / kinds)) if kinds else 0.0
    fresh = float(np.log(discount * kinds / rest)) if kinds else 0.0
    price = np.log(np.maximum(n - discount, 0.05) / max(rest, 1.0)) if len(n) else n
    price[:coded] = 0.0
    base = np.log10((n + 0.5) / (tokens + 0.5 * (distinct + 1)))

    spell_with = spark.sparkContext.broadcast((speller.bits, speller.gates, speller.pairs, speller.meaning, speller.weights, speller.refine))

    def priced_new(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for batch in batches_in:
            m = m or Mixer(*spell_with.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_spelled(m, batch.column(1)) + fresh)], names=["h", "price"])

    base_of = F.log10((F.col("n_train") + 0.5) / F.lit(float(tokens + 0.5 * (distinct + 1))))
    old = words.where("n_train > 0").select("h", F.lit(1).alias("known"), base_of.alias("base"), F.log(F.greatest(F.col("n_train") - discount, F.lit(0.05)) / max(rest, 1.0)).alias("price"))
    new = words.where("n_train = 0").select("h", "word").mapInArrow(priced_new, "h long, price double").select("h", F.lit(0).alias("known"), F.lit(float(np.log10(0.5 / (tokens + 0.5 * (distinct + 1))))).alias("base"), "price")
    priced = old.union(new)

    sent = spark.sparkContext.broadcast((base, price, (mixer.bits, mixer.gates, mixer.pairs, mixer.meaning, mixer.weights, mixer.refine)))  # of fixed size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"), "text")
    near = cut(rows.mapInArrow(_lookup(sent_code, sent), "row long, doc_id long, sig long, n_bytes long, n_tokens long, n_known long, base_score double, total double, rare array<struct<h: long, times: int>>"))
    rare = near.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.times")
    m = F.col("times")
    far = rare.join(priced, "h").groupBy("row").agg(F.sum(m * F.col("known")).alias("n_known"), F.sum(m * F.col("base")).alias("base_score"), F.sum("price").alias("total"))
    whole, summed = ["doc_id", "sig", "n_bytes", "n_tokens"], ["n_known", "base_score", "total"]
    both = near.select("row", *whole, *summed).union(far.select("row", *(F.lit(None).cast("long").alias(x) for x in whole), *summed))
    out = both.groupBy("row").agg(*(F.max(x).alias(x) for x in whole), *(F.sum(x).alias(x) for x in summed))

    # texts that others repeat: a row for each such text, dealt out so that no text is one key
    copies = near.withColumn("learn", learn).groupBy("sig").agg(F.count("*").alias("n"), F.sum(F.col("learn").cast("long")).alias("held")).where("n > 1 and held > 0")
    copies = cut(copies)
    texts, repeated = near.where(learn).count(), copies.where("held > 1").agg(F.sum("held")).first()[0] or 0
    odds = (repeated + 0.5) / (texts + 1)
    spread = copies.select("sig", "held", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    out = out.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)).cast("int")).join(spread, ["sig", "salt"], "left")
    others = F.coalesce(F.col("held"), F.lit(0)) - learn.cast("long")
    by_words = F.col("total") + float(np.log1p(-odds))
    held = F.log(others * float(odds) / max(1, texts))
    total = F.when(others > 0, F.greatest(by_words, held) + F.log1p(F.exp(-F.abs(by_words - held)))).otherwise(by_words)
    score = (total * LOG10_E).alias("score")
    return out.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score", score, F.when(F.col("n_bytes") > 0, -total / (F.col("n_bytes") * float(np.log(2.0)))).alias("bits_per_byte"),
    )
