"""Rows of memories there and back, malformed and partial ones too."""

from datetime import UTC, datetime

from tidemark.functions import codec


def test_round_trip(spark):
    t = datetime(2024, 3, 1, 12, 30, 5, 123456)
    e = {"entity_id": "e1", "label": "Ünï \"q\" \n 汉", "entity_type": "person", "aliases": ["a", None], "description": ""}
    full = {
        "entry_id": 1, "tier": "impression", "title": "t", "content": "c", "scope_type": "tenant", "scope_id": "s", "parent_id": 7, "state_key": "k", "temporal_precision": "hour", "decay": 0.25, "hits": 3,
        "tags": ["x", "y\""], "related_ids": [], "entities": [e, {"entity_id": None, "label": "b", "entity_type": "concept", "aliases": [], "description": "d"}],
        "anchors": [{"anchor_id": "a", "event_at": None, "recorded_at": t, "relative_expression": "三天前", "precision": "day"}],
        "beliefs": [{"belief_id": "b", "content": "c", "confidence": "bedrock", "source": None, "adopted_at": t, "superseded_by": "n", "superseded_at": t}, None],
        "created_at": t, "touched_at": t, "event_start": None, "event_end": t, "memory_type": "plan", "is_active": False,
    }
    rows = spark.createDataFrame([full], codec.MEMORY)
    back = codec.decode(codec.encode(rows))
    assert [r.asDict() for r in back.select(*rows.columns).collect()] == [r.asDict() for r in rows.collect()]
    assert back.first().n_bad == 0
    assert codec.encode(back).collect() == codec.encode(rows).collect()
    assert codec.decode(codec.encode(rows.limit(0))).count() == 0


def test_malformed_and_partial_rows(spark):
    schema = "entry_id long, source_json string, entities_json string, beliefs_json string, created_at string, memory_type string, is_active int, extra string"
    rows = [
        (1, '["p"]', '["name", {"label": "x", "more": 1}, {"label": "y", "aliases": "no list"}]', "", "2024-01-01T00:00:00", "self", 0, "x"),
        (2, None, '[{"label": "x"', '{"content": "no list"}', "2024-01-01T02:00:00+02:00", None, None, "x"),
        (3, "7", "[]", '[{"content": "c", "adopted_at": "2024-01-01T00:00:00Z", "superseded_at": "soon"}]', "yesterday", "event", 1, "x"),
    ]
    got = {r.entry_id: r for r in codec.decode(spark.createDataFrame(rows, schema)).collect()}
    first = datetime(2024, 1, 1, tzinfo=UTC).timestamp()
    stamp = lambda t: t.timestamp()
    assert (got[1].n_bad, got[1].related_ids, got[1].beliefs, got[1].memory_type, got[1].is_active) == (0, ["p"], [], "timeless", False)
    assert [(e.label, e.entity_type, e.aliases) for e in got[1].entities] == [("name", "concept", None), ("x", "concept", None), ("y", "concept", None)]
    assert stamp(got[1].created_at) == stamp(got[2].created_at) == stamp(got[1].touched_at) == first
    assert (got[2].n_bad, got[2].entities, got[2].beliefs, got[2].related_ids, got[2].memory_type, got[2].is_active) == (2, None, None, [], "timeless", True)
    assert (got[3].n_bad, got[3].related_ids, got[3].created_at, got[3].title, got[3].decay, got[3].tags) == (2, None, None, "", 1.0, [])
    assert stamp(got[3].beliefs[0].adopted_at) == first and got[3].beliefs[0].superseded_at is None
    assert "extra" not in codec.decode(spark.createDataFrame(rows, schema)).columns
