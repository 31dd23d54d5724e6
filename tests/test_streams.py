"""Streams in several batches, with restarts, repeated batches and failures between tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.condensation import LOG, condense
from tidemark.plans import stream_queries as sq
from tidemark.streaming import keyed_state
from tidemark.streaming.batch_store import BatchStore, plus, run

STATES = "event_id long, key string, at long, k int"
DAY = 86_400_000_000


def write_parts(spark, folder, rows, schema, first=0, size=40):
    """Files of ``size`` rows each; one is a batch."""
    for n, a in enumerate(range(0, len(rows), size)):
        spark.createDataFrame(rows[a : a + size], schema).coalesce(1).write.parquet(f"{folder}/part={first + n}")


def feed(spark, folder, schema):
    return spark.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).parquet(folder).drop("part")


def newest(rows):
    out = {}
    for event_id, key, at, k in rows:
        last = out.setdefault(key, [None, 0])
        last[1] += 1
        last[0] = max(last[0] or (at, event_id, k), (at, event_id, k))
    return {key: (v[0][1], v[0][0], v[0][2], v[1] - 1) for key, v in out.items()}


def test_keyed_states_in_batches_with_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(n, f"k{rng.randrange(12)}", rng.randrange(300) * DAY // 10, rng.randrange(9)) for n in range(160)]  # any order of times
    write_parts(spark, f"{tmp_path}/in", rows[:80], STATES)
    first = keyed_state.follow_states(feed(spark, f"{tmp_path}/in", STATES), f"{tmp_path}/run", "365 days", 365 * 86400)
    assert {r.key: (r.event_id, r.at, r.k, r.n_closed) for r in first.collect()} == newest(rows[:80])
    write_parts(spark, f"{tmp_path}/in", rows[80:], STATES, first=2)
    second = keyed_state.follow_states(feed(spark, f"{tmp_path}/in", STATES), f"{tmp_path}/run", "365 days", 365 * 86400).collect()
    assert {r.key: (r.event_id, r.at, r.k, r.n_closed) for r in second} == newest(rows) and not any(r.is_idle for r in second)


def test_states_that_stay_become_idle(spark, tmp_path):
    rows = [(1, "old", DAY, 1), (2, "new", 2 * DAY, 2), (3, "new", 40 * DAY, 3), (4, "other", 41 * DAY, 4)]
    for n, r in enumerate(rows):
        write_parts(spark, f"{tmp_path}/in", [r], STATES, first=n)
    got = keyed_state.follow_states(feed(spark, f"{tmp_path}/in", STATES), f"{tmp_path}/run", "1 day", 10 * 86400)
    assert {r.key: (r.event_id, r.n_closed, r.is_idle) for r in got.collect()} == {"old": (1, 0, True), "new": (3, 1, False), "other": (4, 0, False)}


PAIRS = "a long, b long, w double"
SUMS = "a bigint, b bigint, weight double, n bigint"


def summed(batch, store):
    changes = batch.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))
    return {"sums": store.merged("sums", SUMS, ["a", "b"], changes, {"weight": plus, "n": plus})}


def test_snapshot_equals_the_one_shot_sum(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(9), rng.randrange(9), float(rng.randrange(50))) for _ in range(200)]
    write_parts(spark, f"{tmp_path}/in", rows, PAIRS)
    store = BatchStore(spark, f"{tmp_path}/store")
    run(feed(spark, f"{tmp_path}/in", PAIRS), store, summed)
    want = {}
    for a, b, w in rows:
        old = want.get((a, b), (0.0, 0))
        want[a, b] = (old[0] + w, old[1] + 1)
    got = lambda: {(r.a, r.b): (r.weight, r.n) for r in store.snapshot("sums", SUMS).collect()}
    assert got() == want and store.batches().count() == 5
    last = spark.createDataFrame(rows[160:], PAIRS)
    store.write(4, summed(last, store))  # the last batch again
    run(feed(spark, f"{tmp_path}/in", PAIRS), store, summed)  # and a restart with nothing new
    assert got() == want


def test_a_batch_that_fails_between_tables_is_not_seen(spark, tmp_path):
    store = BatchStore(spark, f"{tmp_path}/store")
    docs = lambda a, b: spark.createDataFrame([(k, f"entity{k % 3} something", "src1") for k in range(a, b)], "doc_id long, text string, source string")
    store.write(0, sq.memory_write(docs(0, 6), store))
    tables = sq.memory_write(docs(6, 9), store)
    broken = {"memories": tables["memories"], "entities": tables["entities"].select(F.raise_error(F.lit("lost")).alias("entry_id"))}
    with pytest.raises(Exception, match="lost"):
        store.write(1, broken)
    seen = lambda: (store.read("memories", sq.MEMORIES).count(), store.read("entities", sq.ENTITIES).count(), {r.label: r.n for r in store.snapshot("label_counts", sq.COUNTS).collect()})
    assert seen() == (6, 12, {"entity": 6, "something": 6})
    for _ in range(2):
        store.write(1, sq.memory_write(docs(6, 9), store))
        assert seen() == (9, 18, {"entity": 9, "something": 9})


def test_all_tables_of_a_write(spark, tmp_path):
    store = BatchStore(spark, f"{tmp_path}/store")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    batches = [
        [(1, "我住在上海，我觉得这里的天气很不错", "s"), (2, "garden castle river", "s"), (3, None, None)],
        [(4, "我住在北京，肯定要长期安家了", "s"), (5, "castle garden", "t"), (6, "我住在杭州", "t"), (7, "", "s")],
    ]
    for _ in range(2):
        for n, batch in enumerate(batches):
            store.write(n, sq.memory_write(docs(batch), store))
        assert {(r.a, r.b): r.weight for r in store.snapshot("cooccurrences", sq.MET).collect()} == {("castle", "garden"): 2}
        states = {r.key: (r.newest, r.n) for r in store.snapshot("states", sq.STATES).collect()}
        assert sorted(states.values()) == [(4, 2), (6, 1)] and all(":state:" in k for k in states)
        said = {(r.entry_id, r.content, r.confidence) for r in store.read("beliefs", sq.BELIEFS).collect()}
        assert said == {(1, "这里的天气很不错", "tentative"), (4, "要长期安家了", "confirmed")}
        assert store.read("memories", sq.MEMORIES).count() == 7


def test_empty_store(spark, tmp_path):
    store = BatchStore(spark, f"{tmp_path}/none")
    assert not store.read("memories", sq.MEMORIES).count() and not store.snapshot("label_counts", sq.COUNTS).count()


def test_condensing_twice_takes_each_message_once(spark, tmp_path):
    schema = "session_id long, turn int, role string, content string"
    rows = [(s, t, "user", None if t == 1 else f"s{s}t{t}") for s in range(4) for t in range(3 * s)]
    log = spark.createDataFrame([], LOG)
    total = 0
    for upto in (3, 6, 6, 9):
        new = condense(spark.createDataFrame([r for r in rows if r[1] < upto], schema), log, keep=2).select(*log.columns)
        total += new.count()
        log = spark.createDataFrame(log.union(new).collect(), log.schema)
    by = {}
    for r in log.collect():
        assert r.n == r.upto_place - r.from_place + 1
        by.setdefault(r.session_id, []).extend(range(r.from_place, r.upto_place + 1))
    assert {s: sorted(p) for s, p in by.items()} == {s: list(range(1, 3 * s - 1)) for s in range(1, 4)} and total == 6
    assert next(r for r in log.collect() if r.session_id == 3 and r.from_place == 1).summary == "s3t0"


def test_a_snapshot_reads_the_last_folder_of_a_bucket_alone(spark, tmp_path):
    """However many batches there were, and also by a store that did not write them; an unfinished batch is left out."""
    store = BatchStore(spark, f"{tmp_path}/store")
    docs = lambda a, b: spark.createDataFrame([(k, "garden castle", "s") for k in range(a, b)], "doc_id long, text string, source string")
    for k in range(3):
        store.write(k, sq.memory_write(docs(2 * k, 2 * k + 2), store))
    with pytest.raises(Exception, match="lost"):
        store.write(3, sq.memory_write(docs(6, 8), store) | {"beliefs": docs(6, 8).select(F.raise_error(F.lit("lost")).alias("x"))})
    for some in (store, BatchStore(spark, f"{tmp_path}/store")):
        rows = some.snapshot("label_counts", sq.COUNTS)
        assert {r.label: r.n for r in rows.collect()} == {"garden": 6, "castle": 6}
        assert {f.split("batch=")[1].split("/")[0] for f in rows.inputFiles() if "label_counts" in f} == {"2"}
