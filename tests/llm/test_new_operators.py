"""Filter audit, blocked search and stock packing against brute force, with nulls, ties, repeats, long and empty texts."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocked_search, filter_audit, stock_packing
from tidemark.llm.common import table
from tidemark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, cells string, n int, rank int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- filter audit


def failing(rows):
    """(part, set of filters, good, toxic) of rows (doc_id, text, lang), by the words of the contract."""
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)),
                 any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, _ in rows))
        out.append((lang or "", {f for f, yes in zip("ABCDE", tests, strict=True) if yes}, doc_id))
    return out


def audit_by_hand(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}  # a missing id has no label
    out = []
    for part in {p for p, _, _ in failing(rows)}:
        docs = [(f, d) for p, f, d in failing(rows) if p == part]
        made = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                hit = [(x, d) for x, d in left if f in x]
                left = [(x, d) for x, d in left if f not in x]
                made.append([part, "".join(order), step, len(left), len(hit), sum(f in x for x, _ in docs) - len(hit), sum(x == {f} for x, _ in docs), sum(d in good for _, d in hit), sum(d in toxic for _, d in hit), f])
        total = collections.Counter()
        for r in made:
            total[r[-1]] += r[4]
        out += [(*r[:-1], total[r[-1]]) for r in made]
    return collections.Counter(out)


def test_audit_equals_all_orders_applied(spark):
    rng = random.Random(3)
    long_ = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(260))
    same = long_()
    texts = [None, "", "", " \n", "A" * 9, "short # one", same, same, same, long_() + " X" * 90, long_() + " $", "a b " * 300, "z" * 200_000, long_()]
    rows = [(k, t, (None, "", "en", "de")[k % 4], "x", k, k) for k, t in enumerate(texts * 2)]
    rows += [(6, same, "en", "x", 1, 1), (6, same, "en", "x", 1, 1), (None, same, "de", "x", 1, 1), (None, None, None, None, None, None)]
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 20)] + [(3, 0, 1), (None, 1, 1), (4, None, None)]
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert collections.Counter(map(tuple, got.collect())) == audit_by_hand([r[:3] for r in rows], labels)


def test_audit_of_nothing(spark):
    assert not filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count()


def test_potential_gives_shapley_values(spark):
    rng = random.Random(5)
    worth = [0, *(rng.randrange(1000) for _ in range(31))]
    p = spark.range(1).select(filter_audit.potentials(F.array(*(F.lit(w).cast("long") for w in worth))).alias("p")).first()["p"]
    for i in range(5):
        want = 0
        for order in itertools.permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            want += worth[before | 1 << i] - worth[before]
        assert p[31] - p[31 ^ 1 << i] == want


# ---- blocked search


def search_by_hand(docs, items, top=10):
    counted = [(d, collections.Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, tokens = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text or ""))) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return collections.Counter(out)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    docs = [(k, " ".join(word() for _ in range(rng.choice((1, 5, 40, 200))))) for k in range(900)]
    docs += [(2000 + k, docs[5][1]) for k in range(300)]  # a large group of copies, equal scores
    docs += [(None, docs[7][1]), (None, docs[7][1]), (7, docs[7][1]), (3000, None), (3001, ""), (3002, " -- !"), (3003, "Über STRASSE straße über"), (3004, "w1 " * 40_000 + "only"), (-5, docs[5][1])]
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 30))))) for k in range(40)] + [(50, None), (51, "?!"), (52, "nowhere"), (53, "ÜBER Straße w3"), (54, docs[5][1]), (54, "only"), (None, "w5 w9")]
    items += [(55, " ".join(f"w{k}" for k in range(400)))]
    return docs, items


@pytest.mark.parametrize(("coordinates", "rows", "pairs"), [(256, 1024, 2_000_000), (8, 32, 2_000_000), (256, 64, 20_000)])
def test_search_is_exact(spark, library, monkeypatch, coordinates, rows, pairs):
    """With all coordinates in one cell, with bounds from few coordinates over many cells, and in several passes."""
    monkeypatch.setattr(blocked_search, "COORDINATES", coordinates)
    monkeypatch.setattr(blocked_search, "CELL_ROWS", rows)
    monkeypatch.setattr(blocked_search, "PASS_PAIRS", pairs)
    docs, items = library
    got = blocked_search.search(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert collections.Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == search_by_hand(docs, items)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert not blocked_search.search(none, items).count()
    assert not blocked_search.search(table(spark, SF, "documents"), items.limit(0)).count()


def test_bounds_hold_and_skip(library):
    """No document of a block, found by its rarest asked term, scores above the block's bound; and bounds do tell blocks apart."""
    docs, items = library
    words = sorted({t.encode() for _, text in items for t in TERM.findall(lower(text or ""))})
    place = {w: k for k, w in enumerate(words)}
    vectors = [(len(ts), collections.Counter(place[t] for t in ts if t in place)) for ts in (blocked_search.terms_of(t) for _, t in docs) if ts]
    df = np.bincount([k for _, c in vectors for k in c], minlength=len(words))
    rank = np.empty(len(words), np.int64)
    rank[order := np.argsort(df, kind="stable")] = np.arange(len(words))
    n = len(vectors)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df[order]])
    asked = [np.sort(rank[[place[w] for w in set(blocked_search.terms_of(t))]]) for _, t in items if blocked_search.terms_of(t)]
    work = blocked_search.Workload(rank, weight, n, sum(s for s, _ in vectors), list(range(len(asked))), asked)
    skipped = 0
    for a in range(0, n, 50):
        part = [(s, sorted((int(rank[k]), v) for k, v in c.items())) for s, c in vectors[a : a + 50]]
        cell = blocked_search.Cell(work, np.array([s for s, _ in part]), np.array([len(c) for _, c in part]), np.array([r for _, c in part for r, _ in c], int), np.array([v for _, c in part for _, v in c], int))
        bounds = {(q, t): b for (q, t, _), b in zip(work.lists.tolist(), work.bounds(cell.summary(work)).tolist(), strict=True)}
        skipped += sum(b * blocked_search.SCALE < 10**9 for b in bounds.values())
        for q, terms in enumerate(asked):
            for row in range(len(part)):
                own = [(t, cell.weights[row, np.searchsorted(cell.terms, t)]) for t in terms if t in cell.terms]
                own = [(t, w) for t, w in own if w > 0]
                if own:
                    assert sum(w for _, w in own) <= bounds[q, own[0][0]] * blocked_search.SCALE
    assert skipped


# ---- stock packing


def check_packing(rows, docs, ids):
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, _ in docs:
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            part = ids[doc_id][at : at + r["length"]]
            assert r["start"] == at and r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids[doc_id])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[doc_id])
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    return padding


def encoded(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return {d: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs}


ODD = [None, "", " \n", "it's don't we'll ''s x's 12ab €µ ǅ", "a<|endoftext|>b", "Ÿ é É İ Σας ΟΔΟΣ", "\x1c\x85 a b", "éx", "x" * 9000 + " " + "'" * 50, "word " * 30_000, "¼ ² ª", "a b"]


def test_encoder_is_the_tokenizer(spark, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()] + [(10_000 + k, t) for k, t in enumerate(ODD)]
    ids = encoded(docs)
    for cache in (500_000, 50):
        monkeypatch.setattr(stock_packing, "CACHE", cache)
        encode = stock_packing.encoder.__wrapped__(tokenizer_path("word_bpe_49k.json"))
        for d, t in docs:
            assert encode(t or "") == np.array(ids[d][:-1], "<u4").tobytes()


@pytest.mark.parametrize("size", [0, 1, 12, 200])
def test_stock_packing_round_trip(spark, size):
    docs = [(10_000 + k, t) for k, t in enumerate(ODD)][:size]
    if size > 12:
        docs += [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, length int")
    rows = stock_packing.stock_pack(frame.repartition(3), tokenizer_path("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in rows} == {d for d, _ in docs}
    assert check_packing(rows, docs, encoded(docs)) == 0


def test_repeated_rows_and_missing_ids(spark):
    docs = [(1, "one two three")] * 5 + [(None, "four")] * 3
    rows = stock_packing.stock_pack(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")).collect()
    total = collections.Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert total == {1: 5 * 4, None: 3 * 2}


def test_column_generation_is_optimal(spark):
    """Against all patterns at once, by the bound of the dual prices; and the plan uses up the histogram."""
    rng = np.random.default_rng(2)
    for capacity, count in ((16, 40), (64, 500), (256, 5000)):
        histogram = np.bincount(rng.integers(1, capacity, count), minlength=capacity + 1)
        patterns, x, bound = stock_packing.generate(histogram, capacity)
        used = np.zeros(capacity + 1)
        for p, k in zip(patterns, x, strict=True):
            assert sum(p) <= capacity
            np.add.at(used, p, k)
        assert np.allclose(used, histogram) and bound <= x.sum() + 1e-9 <= bound * (1 + 2 * stock_packing.NEAR_ENOUGH) + 1e-9
        packed, left = stock_packing.plan(histogram, capacity), histogram.copy()
        for p, k in packed:
            assert sum(p) <= capacity
            np.subtract.at(left, list(p), k)
        assert not left.any()
        assert sum(k for _, k in packed) <= 1.1 * x.sum() + 5


def test_knapsack_against_brute_force():
    rng = random.Random(1)
    values = np.array([-np.inf, *(rng.random() * k for k in range(1, 13))])
    best, last = stock_packing.knapsack(values, 12)
    want = [0.0] * 13
    for c in range(1, 13):
        want[c] = max([want[c - 1], *(values[k] + want[c - k] for k in range(1, c + 1))])
    assert np.allclose(best, want)
    assert sum(stock_packing._filled(last, 12)) <= 12
