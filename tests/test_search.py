"""Search for tables of questions, full text by trigrams, duplicates and curation, on small fixtures with Han text, nulls and ties."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import space_words, word_runs
from tidemark.operators import duplicates, posting_blocks, question_search, trigram_index

ENTRY = "entry_id long, tier string, scope_id string, title string, content string, decay double, hits long, created_at long, touched_at long"


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["river", "stone", "the", "of", "anan", "banana", "green", "住在", "北京", "cloud"]) + rng.choice(["", "", "s"])
    rows = [(k, ("impression", "pattern")[k % 2], f"s{k % 3}", word(), " ".join(word() for _ in range(rng.choice((2, 9, 30)))), (k % 7) / 7, k % 20, 1000 * k, 1000 * k + k % 5) for k in range(150)]
    rows += [(200, "impression", "s0", None, None, 0.5, 0, 5, 5), (201, "impression", None, "", "", 0.5, 0, 5, 5), (202, "pattern", "s1", "A.B it's", "x" * 5000 + " river", 0.1, 1, 7, 7)]
    return rows, spark.createDataFrame(rows, ENTRY)


def tokens(text):
    han = "".join(re.findall("[一-鿿]", text or ""))
    return re.findall("[a-z]+", (text or "").lower()) + list(han) + [han[i : i + 2] for i in range(len(han) - 1)]


def test_bm25_of_many_questions(spark, entries):
    rows, frame = entries
    questions = [(1, "river river stone"), (2, "北京 the"), (3, None), (4, "nowhere"), (5, "green clouds of the")] + [(10 + k, "banana of stones") for k in range(20)]
    asked = spark.createDataFrame(questions, "question_id long, text string")
    got = question_search.text_signals(question_search.write_postings(frame), question_search.question_tokens(asked)).where("signal = 'bm25'").collect()
    docs = {r[0]: Counter(tokens(r[4])) for r in rows}
    mean = sum(c.total() for c in docs.values()) / len(docs)
    want = {}
    for q, text in questions:
        raw = Counter()
        for t, times in Counter(tokens(text)).items():
            df = sum(t in c for c in docs.values())
            for d, c in docs.items():
                if t in c:
                    raw[d] += times * math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
        best = max(raw.values(), default=0)
        for d, s in sorted(raw.items(), key=lambda x: (-round(x[1], 6), x[0]))[:30]:
            if s / best > 0.1:
                want[q, d] = round(0.9 * s / best, 9)
    assert {(r.question_id, r.entry_id): round(r.score, 9) for r in got} == want


def test_a_table_of_questions_is_the_questions_one_by_one(spark, entries):
    _, frame = entries
    schema = "question_id long, text string, scope_id string, after long, before long, tiers array<string>"
    questions = [(1, "river stones", "s1", 20_000, 60_000, None), (2, "banana", None, 100_000, None, ["pattern"]), (3, "clouds of green", "s2", None, 30_000, None), (4, None, None, None, None, None), (5, "anan", "no", 50, 40, None)]
    mentions = frame.select("entry_id", F.col("title").alias("label"), "decay")
    beliefs = spark.createDataFrame([(3, 0.5), (3, 0.9), (8, 0.1)], "entry_id long, confidence double")
    links = frame.select("entry_id", F.floor(F.col("entry_id") / 2).alias("to_id"))
    postings = question_search.write_postings(frame)
    found = lambda some: {tuple(r) for r in question_search.search(postings, spark.createDataFrame(some, schema), frame, mentions, beliefs, links, 10).collect()}
    together, apart = found(questions), set()
    for q in questions:
        apart |= found([q])
    assert together == apart and {1, 2, 3} <= {r[0] for r in together} and 4 not in {r[0] for r in together}
    tier = {r[0]: r[1] for r in entries[0]}
    assert all(tier[r[1]] == "pattern" for r in together if r[0] == 2 and not r[4])


def test_ids_that_repeat_are_one_entry(spark):
    rows = [(1, "river stone"), (1, "river cloud"), (1, "stone"), (2, "river stone stone"), (3, "cloud"), (None, "river"), (3, "cloud river stone")]
    frame = spark.createDataFrame([(i, 5 * (i or 1), t) for i, t in rows], "entry_id long, created_at long, content string")
    asked = question_search.question_tokens(spark.createDataFrame([(7, "river stone"), (8, "cloud")], "question_id long, text string"))
    postings = question_search.write_postings(frame)
    # texts of one id and length count together, of other lengths apart: entry 1 holds river once (twice in its texts of two words), stone twice
    assert {tuple(r) for r in question_search.holding_all(postings, asked, 5).collect()} == {(7, 2), (7, 3), (8, 1)}
    raw = {}
    docs = [(1, 4, "river stone river cloud"), (1, 1, "stone"), (2, 3, "river stone stone"), (3, 1, "cloud"), (None, 1, "river"), (3, 3, "cloud river stone")]
    docs[0] = (1, 2, docs[0][2])
    df = Counter(t for _, _, text in docs for t in set(text.split()))
    mean = sum(len(t.split()) for _, t in rows) / len(rows)
    for i, dl, text in docs:
        for t in ("river", "stone"):
            tf = text.split().count(t)
            raw[i] = raw.get(i, 0) + (math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) if tf else 0)
    best = max(raw.values())
    got = {r.entry_id: round(r.score, 9) for r in question_search.text_signals(postings, asked).where("signal = 'bm25' AND question_id = 7").collect()}
    assert got == {i: round(0.9 * x / best, 9) for i, x in raw.items() if x / best > 0.1}


def test_a_task_gives_the_first_entries_of_a_question_not_its_matches(spark):
    frame = spark.range(20_000).selectExpr("id AS entry_id", "id AS created_at", "concat('river stone ', repeat('stone ', int(id % 50))) AS content").repartition(2)
    tokens = question_search.question_tokens(spark.createDataFrame([(k, "river stone") for k in range(5)], "question_id long, text string"))
    asked = posting_blocks.Asked.of(tokens.selectExpr("question_id", "token", "word", "1D AS weight").toArrow())
    postings = question_search.write_postings(frame)
    found = posting_blocks.first_found(postings.rows, asked, lambda tf, dl: tf / dl, newest=50, most=20, best=30, holding=10)
    tasks = found.rdd.getNumPartitions()
    assert found.count() <= tasks * (5 * (50 + 30 + 10) + 2 * 20)  # matches: 20,000 a question
    newest = found.where("kind = 'newest' AND question_id = 3").orderBy(F.desc("place_by")).limit(50).collect()
    assert [r.entry_id for r in newest] == list(range(19_999, 19_949, -1))
    got = {(r.question_id, r.entry_id) for r in question_search.holding_all(postings, tokens, 10).collect()}
    assert got == {(q, 49 + 50 * k) for q in range(5) for k in range(10)}


def test_windows_of_time_meet_few_buckets(spark):
    rng = random.Random(4)
    times = [rng.randrange(0, 3_000_000) for _ in range(600)] + [7_200_000 + rng.randrange(0, 3600) for _ in range(400)] + [20_000_000 + k for k in range(3)] + [None]
    frame = spark.createDataFrame(list(enumerate(times)), "entry_id long, created_at long")
    windows = [(1, None, None), (2, 0, None), (3, None, 7_201_000), (4, 1_000_000, 2_000_000), (5, 2_999_000, 7_200_100), (6, 50, 40), (7, 8_000_000, 9_000_000), (8, None, 19_000_000), (9, 25_000_000, None)]
    asked = spark.createDataFrame(windows, "question_id long, after long, before long")
    want = set()
    for q, after, before in windows:
        inside = [(t, k) for k, t in enumerate(times) if t is not None and (after is not None or before is not None) and t >= (after if after is not None else t) and t <= (before if before is not None else t)]
        want |= {(q, k) for _, k in sorted(inside, key=lambda x: (-x[0], x[1]))[:100]}
    assert {(r.question_id, r.entry_id) for r in question_search.time_signal(asked, frame).collect()} == want
    filled = spark.range(100_000).selectExpr("id AS bucket", "60L AS n")
    spans = spark.createDataFrame([(1, 0, 99_998), (2, 99_990, 99_998), (3, 5, 5)], "question_id long, from long, top long")
    got = {(r.question_id, r.bucket) for r in question_search._newest_buckets(spans, filled).collect()}
    assert got == {(1, 99_998), (1, 99_997), (2, 99_998), (2, 99_997), (3, 5)}


def test_trigram_hits_are_those_that_contain(spark, entries):
    rows, frame = entries
    words = ["river", "ana", "anan", "住在北", "北京", "it", "the", "xxx", "nowhere"]
    index = trigram_index.write_index(frame)
    got = {(r.word, r.entry_id): r.times for r in trigram_index.phrase_hits(index, spark.createDataFrame([(w,) for w in words if len(w) >= 3], "word string")).collect()}
    want = {}
    for r in rows:
        text = "\n".join(x for x in (r[3], r[4]) if x is not None).lower()
        for w in words:
            n = len(re.findall(f"(?={re.escape(w)})", text))
            if n and len(w) >= 3:
                want[w, r[0]] = n
    assert got == want


def test_text_rank_and_its_fallback(spark, entries):
    rows, frame = entries
    queries = [(1, "river AND stone"), (2, "of"), (3, "a.b"), (4, None), (5, ""), (6, "(green) zzz"), (7, "北京")]
    got = {}
    for r in trigram_index.ranked(trigram_index.write_index(frame), spark.createDataFrame(queries, "query_id long, text string"), 500).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.entry_id, r.score))
    text = {r[0]: "\n".join(x for x in (r[3], r[4]) if x is not None).lower() for r in rows}
    assert {d for d, _ in got[1]} == {d for d, t in text.items() if "river" in t and "stone" in t}
    assert [s for _, s in got[1]] == sorted((s for _, s in got[1]), reverse=True)
    made = {r[0]: r[7] for r in rows}
    assert [d for d, _ in got[2]] == sorted((d for d, t in text.items() if "of" in t), key=lambda d: (-made[d], d))  # short words alone: as it is
    assert [d for d, _ in got[3]] == [202] and {d for d, _ in got[7]} == {d for d, t in text.items() if "北京" in t} and not {4, 5, 6} & set(got)


@pytest.mark.parametrize("hot", [256, 4])
def test_duplicate_pairs_against_brute_force(spark, monkeypatch, hot):
    """Also with the sets of a token dealt into many cells."""
    monkeypatch.setattr(duplicates, "HOT_PREFIXES", hot)
    rng = random.Random(2)
    sets = []
    for k in range(60):
        base = [f"t{rng.randrange(80)}" for _ in range(rng.choice((1, 5, 20)))]
        sets += [base, base + [f"u{k}"], base[1:] + ["t1"]]
    rows = [(k, sorted(set(s))) for k, s in enumerate(sets)] + [(900, []), (901, [])]
    got = {(r.a, r.b): round(r.jaccard, 9) for r in duplicates.similar_sets(spark.createDataFrame(rows, "entry_id long, tokens array<string>"), 0.7).collect()}
    first = {}
    for k, s in rows:
        first.setdefault(tuple(s), k)
    want = {}
    for s, a in first.items():
        for t, b in first.items():
            if a < b and s and t and (j := len(set(s) & set(t)) / len(set(s) | set(t))) > 0.7:
                want[a, b] = round(j, 9)
    assert got == want and len(want) > 20


def test_new_memories_are_skipped_merged_or_inserted(spark):
    text = "Alice moved from Berlin to a quiet village near the northern lakes last autumn"
    rows = [(1, text), (2, text), (3, text.replace("Berlin", "Bremen").replace("quiet village near", "noisy hamlet beside")), (4, "nothing of that kind is written here at all"), (5, text.upper())]
    frame = spark.createDataFrame(rows, "entry_id long, content string").withColumn("tokens", word_runs(F.col("content")))
    near = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (5, 1)], "new_id long, entry_id long")
    got = {r.new_id: (r.best_id, r.decision) for r in duplicates.decide(frame, near).collect()}
    assert got[2] == (1, "skip") and got[3] == (1, "merge") and got[4] == (None, "insert")


def test_contradictions_do_not_depend_on_case(spark):
    rows = [(1, "impression", "  He said Yes to everything that was asked of him "), (2, "impression", "he said no to everything that was asked of him"), (3, "impression", "她喜欢在周末的早晨去公园里散步并且和朋友们一起喝一杯热咖啡聊天看书写字"), (4, "impression", "她不喜欢在周末的早晨去公园里散步并且和朋友们一起喝一杯热咖啡聊天看书"), (5, "pattern", "yes, short")]
    got = {(r.tier, r.pair): (r.n_pairs, r.first_pos, r.first_neg) for r in duplicates.contradiction_counts(spark.createDataFrame(rows, "entry_id long, tier string, content string")).collect()}
    assert got["impression", "yes/no"] == (1, 1, 2) and got["impression", "喜欢/不喜欢"][0] == 1 and all(t == "impression" for t, _ in got)


def test_write_check_warns(spark):
    words = [f"w{k}" for k in range(20)]
    rows = [(1, "impression", " ".join(words), 9), (2, "impression", " ".join(words[:19]), 5), (3, "impression", " ".join(words[:15]), 4), (4, "pattern", " ".join(words), 9), (5, "impression", "w1 w2", 9)]
    frame = spark.createDataFrame(rows, "entry_id long, tier string, content string, touched_at long").withColumn("tokens", space_words(F.col("content")))
    got = {(r.new_id, r.entry_id): round(r.overlap, 3) for r in duplicates.recent_overlaps(frame, frame.where("entry_id = 1")).collect()}
    assert got == {(1, 2): 0.95, (1, 3): 0.75}
    assert not duplicates.recent_overlaps(frame, frame.where("entry_id = 1"), n=0).count()


def test_trigram_hits_are_made_where_the_blocks_are_read(spark, entries, monkeypatch):
    """No candidate is shuffled, words in chunks find the same, and blocks invert every gram, also of letters beyond 16 bits."""
    _, frame = entries
    index = trigram_index.write_index(frame)
    words = spark.createDataFrame([(w,) for w in ("river", "anan", "住在北", "the", "nowhere")], "word string")
    whole = trigram_index.phrase_hits(index, words)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(trigram_index, "CHUNK", 2)
    assert sorted(whole.collect()) == sorted(trigram_index.phrase_hits(index, words).collect()) != []
    texts = ["abab", "", "xy", "a😀b😀", "ab😀b"]
    grams, begin, places = trigram_index.inverted(texts)
    got = {(g, int(p)) for k, g in enumerate(grams) for p in places[begin[k] : begin[k + 1]]}
    assert got == {(t[k : k + 3], d) for d, t in enumerate(texts) for k in range(len(t) - 2)} and trigram_index.inverted(["", ""])[0] == []


def test_sets_of_frequent_tokens_meet_only_when_alike(spark, monkeypatch):
    """All tokens are in a third of the sets; what is compared on full sets does not grow with the square of their number."""
    cuts = []
    cut = duplicates.cut
    monkeypatch.setattr(duplicates, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    rng = random.Random(5)
    rows = [(k, sorted(rng.sample([f"t{x}" for x in range(90)], 30))) for k in range(400)]
    rows += [(1000 + k, sorted({*rows[k][1][1:], "new"})) for k in range(20)]  # 29 of 31
    got = sorted((r.a, r.b) for r in duplicates.similar_sets(spark.createDataFrame(rows, "entry_id long, tokens array<string>"), 0.85).collect())
    assert got == [(k, 1000 + k) for k in range(20)]
    assert cuts[-1].columns == ["a", "b"] and cuts[-1].count() < 100  # of 88,000 pairs
