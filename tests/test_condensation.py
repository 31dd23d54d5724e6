"""Tiers condensed in several runs against plain Python, with repeated runs, nulls, ties and a hot cluster."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import condensation
from tidemark.operators.condensation import LINKS, PATTERNS, PRINCIPLES, condense_tiers, crystallise, distil
from tidemark.streaming.batch_store import BatchStore

ENTRIES = "entry_id long, scope_id string, tier string, tags array<string>, content string, created_at long"
LABELS, BELIEFS = "entry_id long, kind string, label string", "entry_id long, belief_id long, content string, confidence string"


def made_id(*parts):
    return hashlib.md5("\x1f".join(map(str, parts)).encode()).hexdigest()[:16]


def most(tags, n):
    return [t for t, _ in sorted(collections.Counter(t for t in tags if t is not None).items(), key=lambda x: (-x[1], x[0]))[:n]]


class Plain:
    """The same runs, one memory at a time."""

    def __init__(self):
        self.seen, self.patterns, self.principles, self.links, self.used = set(), {}, {}, set(), set()

    def run(self, entries, labels, beliefs, run):
        by, sure = {e[0]: e for e in entries}, collections.defaultdict(list)
        for e, b, text, level in beliefs:
            if level in ("confirmed", "bedrock"):
                sure[e].append((e, b, text))
        clusters = collections.defaultdict(set)
        for e, kind, label in labels:
            if label is not None and e in by and by[e][2] == "impression":
                key = (by[e][1] or "", kind or "", label)
                if (e, key) not in self.seen:
                    clusters[key].add(e)
        for key, members in clusters.items():
            if len(members) < 5:
                continue
            self.seen |= {(e, key) for e in members}
            said = sorted(b for e in members for b in sure[e])
            newest = by[max(members, key=lambda e: (by[e][5], e))]
            tags = most([t for e in members for t in by[e][3]], 5)
            name = made_id(*key, run)
            text = condensation.PATTERN_TEXT % (len(members), key[2], ", ".join(tags) or "无", len(said), (newest[4] or "")[:200])
            self.patterns[name] = (*key, f"关于「{key[2]}」的行为模式", text, tags, [b for _, _, b in said[:5]], len(said), len(members), run)
            self.links |= {(name, str(e)) for e in members}
        confirmed = [(n, p[0], p[5], [p[2]]) for n, p in self.patterns.items() if p[7]]
        confirmed += [(str(e[0]), e[1] or "", e[3], [x for i, _, x in labels if i == e[0] and x is not None]) for e in entries if e[2] == "pattern" and sure[e[0]]]
        scopes = collections.defaultdict(list)
        for c in confirmed:
            if c[0] not in self.used:
                scopes[c[1]].append(c)
        for scope, rows in scopes.items():
            if len(rows) >= 3:
                self.used |= {r[0] for r in rows}
                names, tags = sorted({x for r in rows for x in r[3]})[:10], most([t for r in rows for t in r[2]], 3)
                name = made_id("principle", scope, run)
                text = condensation.PRINCIPLE_TEXT % (len(rows), ", ".join(names), ", ".join(tags))
                self.principles[name] = (scope, f"行动原则（基于 {len(rows)} 条已验证模式）", text, tags, names, len(rows), run)
                self.links |= {(name, r[0]) for r in rows}


def world(seed, n=240):
    """A third of the entries is in one scope and says one word; some scopes, kinds, labels, tags and contents are null; labels repeat."""
    rng = random.Random(seed)
    entries, labels, beliefs = [], [], []
    for e in range(n):
        scope = "hot" if e % 3 == 0 else rng.choice(["a", "b", None])
        tags = rng.sample(["t1", "t2", "t3", "t4", "t5", "t6"], rng.randrange(4))
        entries.append((e, scope, rng.choice(["impression"] * 6 + ["pattern", "principle"]), tags, rng.choice([None, "", "短", f"text {e} " * 60]), rng.randrange(20)))
        said = ["common"] * (e % 3 == 0) + rng.choices(["x", "y", "z 人", None], k=2)
        labels += [(e, rng.choice(["person", None]) if w != "common" else "person", w) for w in said]
        beliefs += [(e, 1000 * e + k, f"b{k}", rng.choice(["tentative", "confirmed", "bedrock", None])) for k in range(rng.randrange(3))]
    labels += labels[:50] + [(10**6, "person", "x")]
    return entries, labels, beliefs


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 5)])
def test_runs_against_plain_python(spark, tmp_path, monkeypatch, seed, hot):
    monkeypatch.setattr(condensation, "HOT_LEAST", hot)  # 5: the large clusters go by the broadcast
    entries, labels, beliefs = world(seed)
    store, plain = BatchStore(spark, f"{tmp_path}/store"), Plain()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for run, upto in enumerate((0, 90, 90, 240), 1):
        some = entries[:upto]
        store.write(run, condense_tiers(frame(some, ENTRIES), frame(labels, LABELS), frame(beliefs, BELIEFS), store.read("patterns", PATTERNS), store.read("links", LINKS), run))
        plain.run(some, labels, beliefs, run)
    got = {r.made_id: tuple(r)[1:] for r in store.read("patterns", PATTERNS).drop("batch").select(*(c.split()[0] for c in PATTERNS.split(", "))).collect()}
    assert got == plain.patterns and {p[-1] for p in got.values()} == {2, 4}  # the third run found nothing new
    over = {r.made_id: tuple(r)[1:] for r in store.read("principles", PRINCIPLES).select(*(c.split()[0] for c in PRINCIPLES.split(", "))).collect()}
    assert over == plain.principles and over
    links = store.read("links", LINKS).select("made_id", "source_id").collect()
    assert set(map(tuple, links)) == plain.links and len(links) == len(plain.links)


def test_a_run_that_broke_is_whole_or_absent(spark, tmp_path):
    """Tables of a run that did not reach the log are not read; the run repeated gives the rows of one that never broke."""
    entries, labels, beliefs = world(3, 90)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((entries, ENTRIES), (labels, LABELS), (beliefs, BELIEFS))]
    broken, whole = BatchStore(spark, f"{tmp_path}/broken"), BatchStore(spark, f"{tmp_path}/whole")
    tables = lambda store: condense_tiers(*frames, store.read("patterns", PATTERNS), store.read("links", LINKS), 1)
    with pytest.raises(Exception, match="broke"):
        made = tables(broken)
        broken.write(1, {**made, "links": made["links"].withColumn("made_id", F.raise_error(F.lit("broke")).cast("string"))})
    assert not broken.read("patterns", PATTERNS).count() and not broken.read("links", LINKS).count()
    for store in (broken, whole):
        store.write(1, tables(store))
        store.write(1, tables(store))
    for name, schema in (("patterns", PATTERNS), ("links", LINKS)):
        rows = [sorted(map(str, s.read(name, schema).collect())) for s in (broken, whole)]
        assert rows[0] == rows[1] and rows[0]


def test_thresholds(spark):
    entries = spark.createDataFrame([(e, "s", "impression", ["t"], "c", e) for e in range(6)], ENTRIES)
    labels = spark.createDataFrame([(e, "k", w) for w, n in (("four", 4), ("five", 5)) for e in range(n)], LABELS)
    none = spark.createDataFrame([], LINKS)
    made = distil(entries, labels, spark.createDataFrame([(0, 1, "b", "confirmed")], BELIEFS), none, 1)
    assert [(r.label, r.n_sources, r.beliefs) for r in made["patterns"].collect()] == [("five", 5, ["b"])]
    rows = spark.createDataFrame([(f"p{k}", f"s{k < 2}", ["t"], ["x"], int(k != 4)) for k in range(6)], "made_id string, scope_id string, tags array<string>, labels array<string>, n_beliefs long")
    assert [(r.scope_id, r.n_sources) for r in crystallise(rows, none, 1)["principles"].collect()] == [("sFalse", 3)]
