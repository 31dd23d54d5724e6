"""Edges of merging and splitting histories, rollbacks with their guards, and shortest paths."""

import random

import duckdb

import __spark_entry__ as entry
from tidemark.operators import event_graph, graphs

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, memory_id long, at long, kind string"


def test_edges_of_merges_and_splits(spark):
    events = spark.createDataFrame(
        [(1, 1, 10, "created"), (2, 2, 11, "created"), (3, 1, 12, "revised"), (4, 2, 12, "merged"), (5, 1, 13, "split"), (6, 3, 13, "created"), (7, 3, 14, "touched"), (8, 1, 15, "created"), (9, 4, 16, "merged")], EVENTS
    )
    links = spark.createDataFrame([(4, 1), (4, 1), (4, 2), (4, 9), (4, None), (5, 3), (5, 9), (3, 2), (99, 1), (9, 4), (9, 3), (9, 1)], "event_id long, other_memory long")
    got = sorted((r.relation, r.from_event, r.to_event) for r in event_graph.history_edges(events, links).collect())
    assert got == sorted(
        [("evolves_to", 1, 3), ("evolves_to", 2, 4), ("evolves_to", 3, 5), ("evolves_to", 6, 7), ("merges_into", 3, 4), ("merges_into", 2, 4), ("merges_into", 7, 9), ("merges_into", 8, 9), ("splits_from", 5, 6)]
    )
    assert event_graph.history_edges(events.limit(0), links.limit(0)).count() == 0


def test_rollback_guards_and_order(spark):
    events = spark.createDataFrame([(1, 1, {"title": "a", "content": "x"}), (2, 1, {"title": None}), (3, 1, {}), (4, 2, {"title": "b"}), (5, 1, None)], "event_id long, memory_id long, snapshot map<string,string>")
    entries = spark.createDataFrame([(1, "now", "body"), (2, "two", None), (3, "three", "c")], "memory_id long, title string, content string")
    asked = [(10, 1, 2, 100), (11, 1, 1, 101), (12, 1, 4, 102), (13, 1, 77, 103), (14, 1, None, 104), (15, 1, 3, 105), (16, 1, 5, 106), (17, 2, 4, 100), (18, None, 4, 100), (19, 1, 2, 101)]
    done = event_graph.rollback(events, entries, spark.createDataFrame(asked, "request_id long, memory_id long, target_event long, at long"))
    got = {r.request_id: (r.outcome, r.changed, r.before_title, r.before_content, r.after_title, r.after_content) for r in done.collect()}
    nothing = (None,) * 5
    assert got == {
        10: ("restored", "title", "now", "body", None, "body"), 11: ("restored", "content,title", None, "body", "a", "x"), 12: ("other memory", *nothing), 13: ("missing event", *nothing),
        14: ("missing event", *nothing), 15: ("empty snapshot", *nothing), 16: ("empty snapshot", *nothing), 17: ("restored", "title", "two", None, "b", None), 18: ("other memory", *nothing),
        19: ("restored", "title", "a", "x", None, "x"),
    }
    after = {r.memory_id: (r.title, r.content) for r in event_graph.restored_entries(entries, done).collect()}
    assert after == {1: (None, "x"), 2: ("b", None), 3: ("three", "c")}


def walk(pairs, source, depth):
    """Breadth first; of several parents the least."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, path = [source], {source: [source]}
    for _ in range(depth):
        found = {}
        for node in sorted(level):
            for other in near.get(node, ()):
                if other not in path:
                    found.setdefault(other, node)
        path.update({n: [*path[p], n] for n, p in found.items()})
        level = list(found)
    return path


def test_paths_on_random_graphs(spark):
    for seed in range(2):
        draw = random.Random(seed)
        pairs = {tuple(sorted(draw.sample(range(60), 2))) for _ in range(70)}
        edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")
        node = lambda ids: spark.createDataFrame([(x,) for x in ids], "node long")
        got = {r.node: r.path for r in graphs.paths(edges, node([0]), node([*range(60), 5, 999]), 4).collect()}
        assert got == walk(pairs, 0, 4)


def test_paths_query(spark):
    got = {r.node: (r.steps, r.path) for r in entry.queries()["g09_paths"](spark, SF).collect()}
    rows = duckdb.sql(f"SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) FROM '{SF}/events.parquet' WHERE event_type = 'signup'").fetchall()
    pairs = {(u, u + 1 + k) for u, k in rows}
    assert got and got == {n: (len(p) - 1, p) for n, p in walk(pairs, min(a for a, _ in pairs), 6).items() if n % 50 == 0}
