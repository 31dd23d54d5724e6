"""Full-text search by trigrams, for a table of queries: candidates by intersection, verified on the text, ranked by phrase.

A word of a query matches where it occurs in title or content, whatever its case. Words below three letters are left out; a query of such words alone
falls back to rows that hold the query as it is, newest first. Grams are inverted block by block inside the tasks that read the texts, and a block's candidates are
verified where the block is read: only hits are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.operators.lineage import cut, shared_folder
from tidemark.operators.retrieval import match_words_of

#: Fixed values of the rank: term saturation, weight of the length, least inverse frequency.
RANK_K1, RANK_B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Entries and characters of a block (one text may be longer); words that are sent to the tasks at a time.
BLOCK_ENTRIES, BLOCK_CHARS, CHUNK = 256, 1 << 18, 20_000
BLOCK = "ids array<long>, texts array<string>, lengths array<int>, grams array<string>, begin binary, places binary"
HIT = "word string, entry_id long, times int, length int"


def overlaps_itself(word: str) -> bool:
    """Whether two occurrences of the word can overlap: some beginning of it is also its end."""
    return any(word[:k] == word[-k:] for k in range(1, len(word)))


def laps(text: str, word: str) -> int:
    """At how many places the text holds the word; they may overlap."""
    n, at = 0, text.find(word)
    while at >= 0:
        n, at = n + 1, text.find(word, at + 1)
    return n


def inverted(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(distinct grams, where their places begin, places in ``texts``); None where the texts have too many letters to be taken together."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    known = np.zeros(int(codes.max(initial=0)) + 1, bool)
    known[codes] = True
    letters = np.flatnonzero(known)
    if len(letters) ** 3 * len(texts) >= 1 << 63:
        return None
    a, code = len(letters), (np.cumsum(known) - 1)[codes]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = row[:-2] == row[2:]
    key = np.sort((((code[:-2] * a + code[1:-1]) * a + code[2:]) * len(texts) + row[:-2])[inside])
    gram, place = np.divmod(key[np.diff(key, prepend=-1) > 0], len(texts))
    begin = np.flatnonzero(np.diff(gram, prepend=-1))
    gram = gram[begin]
    every = letters[np.stack([gram // (a * a), gram // a % a, gram % a], axis=1)] if a else np.zeros(0, int)
    run = every.astype("<u4").tobytes().decode("utf-32-le")
    return [run[k : k + 3] for k in range(0, len(run), 3)], np.append(begin, len(place)).astype(np.int32), place.astype(np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (entry_id, text, length)."""

    def made(part: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        got = inverted(texts)
        if got is None:
            half = len(texts) // 2
            yield from made(part.slice(0, half), texts[:half])
            yield from made(part.slice(half), texts[half:])
            return
        grams, begin, places = got
        columns = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string())), pa.array([part.column(2).to_pylist()], pa.list_(pa.int32()))]
        columns += [pa.array([grams], pa.list_(pa.string())), pa.array([begin.tobytes()], pa.binary()), pa.array([places.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["ids", "texts", "lengths", "grams", "begin", "places"])

    for batch in batches:
        texts = batch.column(1).to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        k = 0
        while k < len(texts):
            stop = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK_CHARS, "right"))
            stop = max(k + 1, min(stop, k + BLOCK_ENTRIES))
            yield from made(batch.slice(k, stop - k), texts[k:stop])
            k = stop


@dataclass
class Trigrams:
    blocks: DataFrame  # a row a block: its entries, their texts (lower case) and lengths, the places of every gram
    texts: DataFrame  # entry_id, created_at, title, content
    entries: int
    mean_length: float


def write_index(entries: DataFrame, folder: str | None = None) -> Trigrams:
    """Grams of every entry of ``entry_id, title, content, created_at``, inverted by blocks of entries; nothing is shuffled."""
    spark = entries.sparkSession
    folder = folder or f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
    part = lambda c: F.greatest(F.char_length(F.coalesce(c, F.lit(""))) - 2, F.lit(0))
    seen = Observation()
    rows = entries.select(F.col("entry_id").cast("long").alias("entry_id"), F.lower(F.concat_ws("\n", "title", "content")).alias("text"), (part("title") + part("content")).alias("length"))
    rows.observe(seen, F.count("*").alias("n"), F.sum("length").alias("total")).mapInArrow(_blocks, BLOCK).write.parquet(f"{folder}/blocks")
    return Trigrams(spark.read.parquet(f"{folder}/blocks"), entries.select("entry_id", "created_at", "title", "content"), seen.get["n"], (seen.get["total"] or 0) / max(1, seen.get["n"]))


def phrase_hits(index: Trigrams, words: DataFrame) -> DataFrame:
    """``word, entry_id, times, length``: entries that hold each distinct word of ``words(word)``, of three letters or more.

    An entry is a candidate when it has all grams of the word; its text is read for those words alone. Words go to the tasks a chunk at a time.
    """
    asked = cut(words.select("word").where(F.char_length("word") >= 3).distinct())
    n = max(1, -(-asked.count() // CHUNK))
    share = F.pmod(F.xxhash64("word"), F.lit(n))
    out = _hits(index, asked.where(share == 0))
    for k in range(1, n):
        out = out.union(_hits(index, asked.where(share == k)))
    return out


def _hits(index: Trigrams, words: DataFrame) -> DataFrame:
    asked = [r.word for r in words.collect()]  # of a chunk
    grams = [sorted({w[k : k + 3] for k in range(len(w) - 2)}) for w in asked]
    vocabulary = {g: k for k, g in enumerate(sorted({g for some in grams for g in some}))}
    sent = index.blocks.sparkSession.sparkContext.broadcast((asked, [np.array([vocabulary[g] for g in some]) for some in grams], pa.array(list(vocabulary), pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, codes, vocabulary = sent.value
        times_in = [laps if overlaps_itself(w) else str.count for w in asked]  # words that cannot overlap themselves are counted at once
        names = pa.array(asked, pa.string())
        for batch in batches:
            for k in range(len(batch)):
                ids, texts, lengths, grams = (batch.column(c)[k].values for c in range(4))
                begin, places = np.frombuffer(batch.column(4)[k].as_py(), np.int32), np.frombuffer(batch.column(5)[k].as_py(), np.uint8)
                code = pc.fill_null(pc.index_in(grams, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                size = np.diff(begin)
                code = np.repeat(code, size)
                held = np.zeros((len(vocabulary), len(ids)), bool)
                held[code[code >= 0], places[code >= 0]] = True
                texts, word, at, times = texts.to_pylist(), [], [], []
                for w, some in enumerate(codes):
                    for e in np.flatnonzero(held[some].all(axis=0)).tolist():
                        t = times_in[w](texts[e], asked[w])
                        if t:
                            word.append(w)
                            at.append(e)
                            times.append(t)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(word, pa.int64())), ids.take(at), pa.array(times, pa.int32()), lengths.take(at)], names=["word", "entry_id", "times", "length"])

    return index.blocks.mapInArrow(run, HIT)


def ranked(index: Trigrams, queries: DataFrame, n: int = 20) -> DataFrame:
    """``query_id, entry_id, score, place``: the ``n`` best entries of each of ``queries(query_id, text)`` that hold all its words.

    Null queries find nothing. A query whose words find nothing, or are all short, takes the newest entries that hold it as it is, at score 0.
    """
    words = cut(queries.select("query_id", F.explode(F.array_distinct(match_words_of(F.col("text")))).alias("word")).where(F.char_length("word") >= 3))
    hits = cut(phrase_hits(index, words))
    frequency = hits.groupBy("word").agg(F.count("*").alias("df"))
    n_all = F.lit(index.entries)
    idf = F.greatest(F.lit(LEAST_IDF), F.log((n_all - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("times") * (RANK_K1 + 1) / (F.col("times") + RANK_K1 * (1 - RANK_B + RANK_B * F.col("length") / F.lit(index.mean_length or 1.0)))
    weighed = words.join(frequency.withColumn("idf", idf), "word")
    met = weighed.join(hits, "word").groupBy("query_id", "entry_id").agg(F.count("*").alias("held"), F.round(F.sum(part), 6).alias("score"))
    met = met.join(words.groupBy("query_id").agg(F.count("*").alias("wanted")), "query_id").where("held = wanted")
    best = cut(store.per_key(met, ["query_id"], n, F.desc("score"), "entry_id", rank="place").select("query_id", "entry_id", "score", "place"))
    rest = queries.where(F.col("text") != "").join(best.select("query_id"), "query_id", "left_anti").select("query_id", F.lower("text").alias("like"))
    # few queries: each is one substring test a text
    held = index.texts.select("entry_id", "created_at", F.lower("title").alias("title"), F.lower("content").alias("content")).join(F.broadcast(rest), F.contains("content", F.col("like")) | F.contains("title", F.col("like")))
    held = store.per_key(held, ["query_id"], n, F.desc("created_at"), "entry_id", rank="place")
    return best.union(held.select("query_id", "entry_id", F.lit(0.0).alias("score"), "place"))
