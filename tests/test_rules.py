"""Facts about single rules, and queries that SQL cannot say in time against plain Python."""

import collections

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions.text import NEGATIONS, intent, judge_tokens, memory_type, state_key
from tidemark.operators import duplicates, history, retrieval
from tidemark.sources.tables import load

SF = "/root/testdata/sf0.001"


def say(spark, rows, f):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(f(F.col("t"))).collect()]


def test_types_and_intents(spark):
    assert say(spark, ["他住在北京", "计划下周去上海", "用户喜欢黑暗模式", "没有驾照", "今天天气很好", "no idea"], memory_type) == ["state", "plan", "preference", "absence", "event", "absence"]
    assert say(spark, ["他现在住在哪里", "去年发生了什么", "下周有什么计划", "how long was it", "2024-05-01", "?"], intent) == ["current_state", "historical_range", "upcoming", "duration", "specific_date", "any"]
    assert say(spark, ["他目前在字节跳动工作", "a b cdefgh"], lambda t: state_key(F.lit("u"), t)) == ["u:state:工作", "u:state:abcd"]
    assert set(say(spark, ["我们在 here"], judge_tokens)[0]) == {"here", "我", "们", "在", "我们", "们在", "我们在"}


def test_contradictions_are_counted(spark):
    texts = ["用户喜欢 Python" + "x" * 30, "用户不喜欢 Python" + "x" * 30, "yes it is" + "x" * 30, "no it is not, " + "x" * 30, "yes and no " + "x" * 30, "short no"]
    docs = spark.createDataFrame([("t", x) for x in texts], "tier string, content string")
    got = {r.pair: r.n_pairs for r in duplicates.contradiction_counts(docs).collect()}
    long = [x for x in texts if len(x) >= 30]
    want = collections.Counter(f"{p}/{n}" for k, a in enumerate(long) for b in long[k + 1 :] for p, n in NEGATIONS if (p in a and n in b) or (n in a and p in b))
    assert got == dict(want)


@pytest.mark.parametrize("above", [0.5, 0.7, 0.85])
def test_similar_sets(spark, above):
    rows = [(r.doc_id, sorted(set((r.text or "").lower().split()))) for r in load(spark, SF, "documents").collect()] + [(9000, []), (9001, []), (9002, ["a", "b"]), (9003, ["a", "b", "c"])]
    classes = {}
    for i, t in sorted(rows):
        classes.setdefault(tuple(t), i)
    items = sorted((i, set(t)) for t, i in classes.items() if t)
    want = {(i, j) for k, (i, x) in enumerate(items) for j, y in items[k + 1 :] if len(x & y) / len(x | y) > above}
    assert {(r.a, r.b) for r in duplicates.similar_sets(spark.createDataFrame(rows, "entry_id long, tokens array<string>"), above).collect()} == want


def test_clocks(spark):
    clock = lambda s: F.from_json(F.lit(s), "map<string,int>")
    cases = [('{"a":2,"b":1}', '{"b":3,"c":1}', "concurrent"), ('{"a":1}', '{"a":1}', "equal"), ('{"a":1}', '{"a":1,"b":1}', "b"), ('{"a":2}', '{"a":1}', "a")]
    for x, y, want in cases:
        row = spark.range(1).select(history.compare_clocks(clock(x), clock(y)).alias("r"), history.merge_clocks(clock(x), clock(y)).alias("m")).first()
        assert row.r == want
    assert retrieval.match_words('is "tion" AND (There) to') == ["tion", "there"] and retrieval.match_words("a be") == ["a", "be"]


def test_components_and_paths(spark):
    links = collections.Counter()
    for r in load(spark, SF, "events").where("event_type = 'signup'").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).collect():
        links[tuple(sorted((r.user_id, r.user_id + 1 + r.k)))] += 1
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)

    def walk(start, depth):
        seen, edge = {start: 0}, [start]
        for d in range(1, depth + 1):
            edge = [y for x in edge for y in near[x] if y not in seen and not seen.setdefault(y, d) is None]
        return seen

    start = min(a for a, _ in links)
    assert {r.node: r.depth for r in entry.queries()["g09_path_lengths"](spark, SF).collect()} == walk(start, 6)
    strong = {x: min(walk(x, 10**4)) for x in near}
    sizes = collections.Counter(strong.values())
    got = {r.node: (r.community, r["size"]) for r in entry.queries()["g10_communities"](spark, SF).collect()}
    assert got == {x: (c, sizes[c]) for x, c in strong.items() if sizes[c] >= 2}
