"""Blocks of the searches of op9 and op12: bounded in memory, and nothing is lost at their edges."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import audio_fingerprints as af
from tidemark.llm import blocked_search


def test_queries_meet_recordings_in_small_blocks(monkeypatch):
    """Recordings lie so near that a query may stand over two of them; each alignment is that of one, and no block of sums outgrows the cache."""
    rng = np.random.default_rng(4)
    held = [rng.integers(0, 1 << 32, int(k), dtype=np.uint32) for k in rng.integers(1, 120, 60)]
    held += [np.concatenate([held[k][-20:], held[k + 1][:20]]) for k in range(8)]
    asked = [x[k : k + 62].copy() for x in held for k in (0, len(x) // 3)] + [x[-15:] for x in held]
    for x in asked[::3]:
        x ^= (rng.random((len(x), 32)) < 0.2).dot(1 << np.arange(32, dtype=np.uint64)).astype(np.uint32)
    asked += [asked[k] for k in range(80)]
    made = []
    irfft = np.fft.irfft
    monkeypatch.setattr(af.np.fft, "irfft", lambda *a: made.append(irfft(*a)) or made[-1])
    sizes = lambda xs: np.array([len(x) for x in xs])
    got = {(int(q), int(r), int(o)): (int(v), round(float(e), 9)) for part in af._search(np.concatenate(asked), sizes(asked), np.concatenate(held), sizes(held)) for q, r, o, v, e in zip(*part, strict=True)}
    assert max(x.nbytes for x in made) <= 2 << 20

    want = {}
    for q, x in enumerate(asked):
        for r, y in enumerate(held):
            least = af._least_overlap(min(len(x), len(y)))
            for o in range(-len(x) + 1, len(y)):
                a, b = x[max(0, -o) : len(y) - o], y[max(0, o) : o + len(x)]
                if len(a) >= least:
                    differ = int(np.bitwise_count(a ^ b).sum())
                    if differ <= af.MAX_ERROR * 32 * len(a):
                        want[q, r, o] = (32 * len(a) - differ, round(differ / (32 * len(a)), 9))
    assert got == want and len(want) > 200


def test_a_file_of_the_index_holds_few_cells(spark, monkeypatch):
    """A reader takes a file into memory at a time, so files are cut by what their cells weigh; what is found stays the same."""
    rng = np.random.default_rng(7)
    words = [f"word{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, 12))) for k in range(1500)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(rng.choice(words, 6))) for k in range(20)], "item_id long, text string")
    want = sorted(map(tuple, blocked_search.search(docs, items).collect()))
    folders = []
    monkeypatch.setattr(blocked_search, "remove", lambda _, path: folders.append(path))
    monkeypatch.setattr(blocked_search, "FILE_BYTES", 1)
    monkeypatch.setattr(blocked_search, "CELL_ROWS", 32)
    got = sorted(map(tuple, blocked_search.search(docs, items).collect()))
    index = next(x for x in folders if x.endswith("/index"))
    cells = spark.read.parquet(index).withColumn("file", F.input_file_name()).groupBy("file").count().collect()
    assert got == want and len(cells) >= 40 and all(r["count"] == 1 for r in cells)
