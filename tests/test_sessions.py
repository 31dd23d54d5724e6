"""Sessions over many batches, out of order, with late rows, a restart and a failed batch."""

import random

import pytest

from tidemark.streaming import sessions
from tidemark.streaming.batch_store import BatchStore, run

GAP, LATE = 10, 40


def plain(rows):
    """Gaps and islands."""
    out, last = {}, {}
    for key, at in sorted(rows):
        if key in last and at - last[key] <= GAP:
            out[key][-1][1:] = [at, out[key][-1][2] + 1]
        else:
            out.setdefault(key, []).append([at, at, 1])
        last[key] = at
    return {k: [tuple(s) for s in v] for k, v in out.items()}


def split_late(batches):
    newest, kept, late = None, [], {}
    for n, batch in enumerate(batches):
        for key, at in batch:
            if key is None or at is None:
                continue
            if newest is not None and at < newest - LATE:
                late[n] = late.get(n, 0) + 1
            else:
                kept.append((key, at))
        times = [at for key, at in batch if key is not None and at is not None]
        newest = max([t for t in [newest, *times] if t is not None], default=None)
    return kept, late


def feed(spark, folder):
    return spark.readStream.schema("key long, at long, part int").option("maxFilesPerTrigger", 1).parquet(folder).drop("part")


def test_sessions_equal_gaps_and_islands(spark, tmp_path):
    draw = random.Random(3)
    batches = []
    for n in range(9):
        batch = [(draw.randrange(8), n * 30 + draw.randrange(-60, 30)) for _ in range(25)] + [(0, n * 30 + k % 30) for k in range(40)]
        draw.shuffle(batch)
        batches.append(batch + [(None, 5), (3, None)])
    batches.insert(4, [(None, None)])
    folder, store = str(tmp_path / "in"), BatchStore(spark, str(tmp_path / "out"))
    write = lambda n: spark.createDataFrame(batches[n], "key long, at long").coalesce(1).write.parquet(f"{folder}/part={n}")
    for n in range(5):
        write(n)
    tables = sessions.session_tables(GAP, LATE)
    run(feed(spark, folder), store, tables)
    for n in range(5, 10):
        write(n)

    def breaks(batch, store):
        return tables(batch, store) | {"open": tables(batch, store)["open"].selectExpr("raise_error('lost') AS x")}

    with pytest.raises(Exception, match="lost"):
        run(feed(spark, folder), store, breaks)
    run(feed(spark, folder), store, tables)
    kept, late = split_late(batches)
    got, open_ = {}, set()
    for r in sessions.read_sessions(store).collect():
        got.setdefault(r.key, []).append((r.start_at, r.end_at, r.n))
        if r.is_open:
            open_.add((r.key, r.start_at))
    assert {k: sorted(v) for k, v in got.items()} == plain(kept)
    assert late and {r.batch: r.n for r in sessions.late_counts(store).collect()} == late
    total = sum(len(v) for v in got.values())
    assert 0 < len(open_) < total


def test_hot_key_is_counted_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("CAST(1 AS BIGINT) AS key", "id % 50 AS at")
    assert sessions.pieces(rows, GAP).count() == 5
    assert [tuple(r) for r in sessions.joined(sessions.pieces(rows, GAP), GAP).collect()] == [(1, 0, 49, 1000)]
