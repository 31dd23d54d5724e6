"""What is taken out of sentences, against what a reader would take; hashed vectors and pairs in blocks against plain Python."""

import collections
import datetime
import hashlib
import itertools
import math
import random

from pyspark.sql import functions as F

from tidemark.functions import extraction
from tidemark.operators import graphs, retrieval


def say(spark, rows, f):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(f(F.col("t"))).collect()]


def test_names(spark):
    names = [[(n.label, n.kind) for n in x] for x in say(spark, ["John Smith met Mary Jones", "He likes Python and Docker", "Smith Systems Inc", "", None, "王小明住在上海市"], extraction.named_entities)]
    assert names[0] == [("John Smith", "person"), ("Mary Jones", "person")]
    assert names[1] == [("Python", "artifact"), ("Docker", "artifact")]
    assert names[2] == [("Smith Systems Inc", "organization")]
    assert names[3] == names[4] == []
    assert names[5][0][1] == "person" and any(kind == "location" for _, kind in names[5])
    many = " and ".join(f"Ann {a}ob" for a in "BCDFGHJKLMNP")
    assert len(extraction.tag_names(many)) == 10
    # a person is left out where it shares a character with another name, not because its text occurs elsewhere
    assert extraction.tag_names("Python Java Smith") == [{"label": "Python", "kind": "artifact"}, {"label": "Java", "kind": "artifact"}]


def test_beliefs_and_facts(spark):
    text = "我确定这个方案是可行的。也许明天会下雨吧。框架：Spark，很好"
    assert [tuple(b) for b in say(spark, [text], extraction.beliefs)[0]] == [("这个方案是可行的", "confirmed"), ("明天会下雨吧", "speculative")]
    assert say(spark, [text, "", None], extraction.names_after) == [["Spark"], [], None]
    assert say(spark, ["0123456789abc nation here. And so on", "nothing", None], lambda t: extraction.fact(t, "nation")) == ["9abc nation here.", "nothing", None]
    assert say(spark, ["用户喜欢 Python 和 a"], extraction.keywords) == [["用户喜欢", "Python"]]


def test_time_hints_and_dates(spark):
    day = lambda d: datetime.date(2024, 5, d)
    now = F.lit("2024-05-15 13:00:00").cast("timestamp")  # a Wednesday
    hints = [tuple(x) for x in say(spark, ["今天做什么", "昨天", "前天", "本周", "上周", "最近", "?", "上周和今天"], lambda t: extraction.time_hint(t, now))]
    assert hints == [(day(15), day(16)), (day(14), day(15)), (day(13), day(14)), (day(13), None), (day(6), day(13)), (None, None), (None, None), (day(15), day(16))]
    assert say(spark, ["March 5th", " may 12 ", "soon", "Moon 3"], extraction.date_variants) == [
        ["March 5th", "Mar 5", "March 5", "3/5", "3-5"], ["may 12", "May 12", "may 12", "5/12", "5-12"], ["soon"], ["Moon 3"],
    ]
    assert say(spark, ["seventeen of 30 and One hundred", "", "none"], extraction.named_numbers) == [[17, 30, 1, 100], [], []]


def test_hash_embedding(spark):
    texts = ["Hello, World", "a", "", None, "éé ée", "abab" * 50]
    got = collections.defaultdict(dict)
    for r in extraction.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect():
        got[r.k][r.dim] = r.value
    for k, t in enumerate(texts):
        t = (t or "").lower()
        sums = collections.Counter()
        for run in {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}:
            md = hashlib.md5(run.encode()).digest()
            for j in range(4):
                sums[int.from_bytes(md[4 * j : 4 * j + 4], "little") % 1024] += 1 if md[j] >= 128 else -1
        norm = math.sqrt(sum(v * v for v in sums.values()))
        want = {d: v / norm for d, v in sums.items() if v}
        assert got[k].keys() == want.keys() and all(abs(got[k][d] - want[d]) < 1e-12 for d in want)


def test_pairs_in_blocks(spark):
    dice = random.Random(3)
    rows = [(dice.choice("ggggab"), dice.randrange(150)) for _ in range(900)] + [("n", None), (None, 1), (None, 2)]
    groups = collections.defaultdict(set)
    for g, x in rows:
        if x is not None:
            groups[g].add(x)
    want = collections.Counter(p for xs in groups.values() for p in itertools.combinations(sorted(xs), 2))
    for block in (7, 64, 10_000):
        got = {(r.a, r.b): r.weight for r in graphs.cooccurrence(spark.createDataFrame(rows, "g string, x int"), "g", "x", block).collect()}
        assert got == want


def test_groups_and_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    dice = random.Random(5)
    rows = [(dice.randrange(40), dice.randrange(60)) for _ in range(900)] + [(50, None), (None, 1), (None, 2)]
    groups = collections.defaultdict(set)
    for g, x in rows:
        if x is not None:
            groups[g].add(x)
    want = collections.Counter(p for xs in groups.values() for p in itertools.combinations(sorted(xs), 2))
    monkeypatch.setattr(graphs, "PART_ROWS", 50)
    pairs = graphs.cooccurrence(spark.createDataFrame(rows, "g int, x int"), "g", "x")
    assert {(r.a, r.b): r.weight for r in pairs.collect()} == want
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().toString()


def test_intent_scores(spark):
    day, now = 86400, 100 * 86400
    rows = [
        ("current_state", "state", True, now, None, 0.75), ("current_state", "preference", True, None, None, 0.65), ("current_state", "event", False, None, None, 0.3),
        ("historical_range", "event", False, now - 30 * day, now - 30 * day, 0.6), ("upcoming", "plan", True, now + 7 * day, None, 0.85), ("duration", "state", True, None, None, 0.5),
        ("specific_date", "plan", True, now, None, 0.6), ("any", "plan", True, now, None, 0.5),
    ]
    df = spark.createDataFrame([(0.5, *r) for r in rows], "score double, intent string, memory_type string, is_active boolean, starts_at long, ends_at long, want double")
    for r in df.select("want", retrieval.intent_score(F.lit(now)).alias("got")).collect():
        assert abs(r.got - r.want) < 1e-9
