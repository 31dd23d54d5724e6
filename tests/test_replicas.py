"""Replicas: merges commute, associate and are idempotent; changes of a second replica against a plain walk."""

import random

import pytest

from tidemark.operators import replicas


def covers(w, v):
    """Versions as (memory, field, node, tick, at, value, clock)."""
    return w[3] > v[3] if w[2] == v[2] else w[6].get(v[2], 0) >= v[3]


def random_log(seed, nodes="abc", n=120):
    """Changes by nodes that hear of each other now and then; times rise but tie often."""
    draw, out, heard, own = random.Random(seed), [], {}, {}
    for step in range(n):
        memory, field, node = draw.randrange(6), draw.choice(["title", "content", "tag"]), draw.choice(nodes)
        clocks = heard.setdefault((memory, field), {x: {} for x in nodes})
        if draw.random() < 0.4:
            other = draw.choice(nodes)
            clocks[node] = {x: max(clocks[node].get(x, 0), clocks[other].get(x, 0)) for x in nodes}
        own[memory, field, node] = own.get((memory, field, node), 0) + 1
        clocks[node] = {**clocks[node], node: own[memory, field, node]}
        out.append((memory, field, node, own[memory, field, node], step // 3, draw.choice([None, f"v{step}", "same"]), dict(clocks[node])))
    return out


def by_field(rows):
    out = {}
    for r in rows:
        out.setdefault((r["memory_id"], r["field"]), []).append((r["place"], r["value"], r["node"], r["at"], r["conflict"]))
    return {k: sorted(v) for k, v in out.items()}


def brute(log):
    out = {}
    for v in log:
        if not any(covers(w, v) for w in log if w[:2] == v[:2]):
            out.setdefault(v[:2], set()).add((v[4], v[2], v[3], v[5]))
    return {k: [(p, x[3], x[1], x[0], len(v) > 1) for p, x in enumerate(sorted(v, key=lambda x: x[:3], reverse=True), 1)] for k, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_merge_is_a_merge(spark, seed):
    log = random_log(seed)
    draw = random.Random(seed + 100)
    parts = [[v for v in log if draw.random() < 0.6] for _ in range(3)]
    a, b, c = (replicas.snapshot_of(spark.createDataFrame(p, replicas.LOG)) for p in parts)
    merge, rows = replicas.merge_snapshots, lambda s: by_field(replicas.field_rows(s).collect())
    ab = rows(merge(a, b))
    assert ab == rows(merge(b, a)) == rows(merge(merge(a, b), b))
    assert rows(merge(a, a)) == rows(a)
    assert rows(merge(merge(a, b), c)) == rows(merge(a, merge(b, c)))
    seen = {v[:4]: v for p in parts[:2] for v in p}
    assert ab == brute(list(seen.values()))
    assert any(len(v) > 1 for v in ab.values()) and any(len(v) == 1 for v in ab.values())


def test_repeated_and_empty_changes(spark):
    v = (1, "title", "a", 1, 5, "x", {"a": 1})
    rows = [v, v, (1, "title", "a", None, 9, "no tick", None), (None, "title", "a", 2, 9, "no memory", None), (2, None, "a", 1, 9, "no field", None), (3, "title", "b", 1, None, None, None)]
    got = by_field(replicas.field_rows(replicas.snapshot_of(spark.createDataFrame(rows, replicas.LOG))).collect())
    assert got == {(1, "title"): [(1, "x", "a", 5, False)], (3, "title"): [(1, None, "b", 0, False)]}
    none = replicas.snapshot_of(spark.createDataFrame([], replicas.LOG))
    assert replicas.merge_snapshots(none, none).count() == 0


def test_changes_of_a_second_replica(spark, tmp_path):
    entries = spark.createDataFrame([(1, {"title": "old", "tag": "t"}, True, 10), (2, {"title": "two"}, True, 10), (3, {"title": "three"}, True, 50), (4, {"title": "four"}, True, 10)], "memory_id long, fields map<string,string>, is_active boolean, touched_at long")
    log = [
        (1, 1, "update", {"title": "late"}, "b", {"b": 2}, 30, "pending"), (2, 1, "update", {"title": "early", "note": None}, "b", {"b": 1}, 20, "pending"),
        (3, 2, "delete", {}, "b", {"b": 1}, 20, "pending"), (4, 3, "update", {"title": "stale"}, "b", {"b": 1}, 50, "pending"),
        (5, 4, "update", {"title": "clash"}, "b", {"b": 1}, 20, "pending"), (6, 5, "create", {"title": "new"}, "c", {"c": 1}, 20, "pending"),
        (7, 6, "update", {"title": "of nothing"}, "c", {"c": 1}, 20, "pending"), (8, 1, "move", {"title": "?"}, "c", {"c": 1}, 90, "pending"),
        (9, 1, "update", {"title": "mine"}, "a", {"a": 1}, 90, "pending"), (10, 1, "update", {"title": "done"}, "b", {"b": 1}, 90, "done"),
        (11, 5, "delete", None, "c", {"c": 2}, 40, "pending"), (12, 5, "create", None, "c", {"c": 3}, 60, "pending"), (13, 1, None, {"title": "?"}, "c", {"c": 1}, 90, "pending"),
    ]
    spark.createDataFrame(log, replicas.CHANGE).write.parquet(str(tmp_path / "there"))
    mine = spark.createDataFrame([(90, 4, "update", {}, "a", {"a": 1}, 1, "inflight"), (91, 1, "update", {}, "a", {"a": 1}, 1, "done"), (92, 4, "update", {}, "a", {"a": 2}, 1, "pending")], replicas.CHANGE)
    judged = replicas.judge(replicas.open_log(spark, str(tmp_path / "there"), "a"), entries, mine, "a")
    assert {r.sync_id: r.decision for r in judged.collect()} == {1: "apply", 2: "apply", 3: "apply", 4: "skip", 5: "conflict", 6: "apply", 7: "apply", 8: "conflict", 11: "apply", 12: "apply", 13: "conflict"}
    after = {r.memory_id: (r.fields, r.is_active, r.touched_at) for r in replicas.apply_changes(entries, judged).collect()}
    assert after == {
        1: ({"title": "late", "tag": "t", "note": None}, True, 30), 2: ({"title": "two"}, False, 20), 3: ({"title": "three"}, True, 50), 4: ({"title": "four"}, True, 10), 5: ({"title": "new"}, True, 60),
    }
    assert {r.status for r in replicas.handed_over(judged).where("sync_id IN (5, 8, 13)").collect()} == {"conflict"}
    with pytest.raises(FileNotFoundError):
        replicas.open_log(spark, str(tmp_path / "nowhere"), "a")
