"""The ten operators against brute force on small tables, edge cases included."""

import collections
import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audio_fingerprints, chat_format, context_mixing, factor_quality, near_dedup, personal_data
from tidemark.llm.best_fit_packing import LENGTH, pack, plan
from tidemark.llm.chat_template import TemplateError, compile_template
from tidemark.llm.common import cut, table
from tidemark.llm.components import connected_components
from tidemark.llm.compression_bands import CHUNK, CHUNKS, chunks_of, with_compression_verdict
from tidemark.llm.minimax_shards import minimax_shards, smallest_capacity
from tidemark.llm.pareto_mix import mix_rows, pareto_mix, spread
from tidemark.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, code string, size string, keys string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, clashes, a long text, and columns named like the operators' own."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = " ".join(rng.choice(words) for _ in range(120))
    texts = [None, "", "  \n\t ", "one two", "one two", "ONE two", base, base, base + " more", base.replace(words[0], "zz", 1), "x" * 30000, " ".join(words * 60), "a.b@c.de x +1 (234) 555-0000 x 10.0.0.1 x 4111 1111 1111 1111"]
    rows = [(k, t, "en", f"s{k % 3}" if k != 4 else None, len(t or ""), "r", "c", "z", "k") for k, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", "en", None, 5, "r", "c", "z", "k")]
    return spark.createDataFrame(rows, DOC)


def shingles(text):
    w = [x.encode().decode() for x in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))


def classes(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, odd, percent):
    for docs in (table(spark, SF, "documents"), odd.where("doc_id is not null")):
        want = classes([(r.doc_id, r.text) for r in docs.collect()], percent)
        got = near_dedup.near_duplicates(docs, percent).collect()
        assert len(got) == docs.count()
        assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(90):
        text = list(base)
        for _ in range(rng.randrange(8)):
            text[rng.randrange(150)] = f"x{rng.randrange(99999)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 85, block=16).collect()} == want


def test_chance_matches():
    rng = np.random.default_rng(0)
    draw = lambda n: near_dedup.sketch(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)))
    seen = np.mean([((a := draw(2000)) == draw(2000)).mean() for _ in range(300)])
    assert seen == pytest.approx(near_dedup.chance_matches(np.array([2000.0]), np.array([2000.0]))[0], rel=0.35)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_rounds_leave_one_checkpoint(spark):
    """A chain takes many rounds; only the files of the last one stay, and the result can be read from them again."""
    folder = pathlib.Path(cut(spark.range(1))._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")).parent
    before = set(folder.iterdir())
    out = connected_components(spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long"))
    assert len(set(folder.iterdir()) - before) == 1
    assert out.count() == 301 and out.where("component <> 0").count() == 0


def test_quality(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    machine = factor_quality.train(docs, labels)
    scored = factor_quality.with_quality(docs.select("doc_id", "text"), machine).join(labels, "doc_id").toPandas()
    held = scored[[zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]]
    report = factor_quality.held_out_report(held)
    assert report["auc"] > 0.97 and report["accuracy"] > 0.9
    assert all(0 <= r.score <= 1 for r in factor_quality.with_quality(odd, machine).collect())


def test_pair_identity():
    rng = np.random.default_rng(2)
    m = factor_quality.Machine(0.1, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.array([3, 7, 11]), np.array([0.5, 2.0, 1.0])
    slow = 0.1 + m.weight[index] @ value + sum(m.factor[index[i]] @ m.factor[index[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert m.raw(index, value) == pytest.approx(slow)


def test_mixing(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = pareto_mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(sizes)
    want = dict(zip(names, spread(1.5 * sum(sizes.values()), [(5, 2, 1)[k % 3] for k in range(len(names))], [2 * sizes[n] for n in names]), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[n] / want[n] - 1) < 0.03 for n in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, pareto_mix(docs).collect()))
    assert pareto_mix(odd).count() == odd.count()
    assert mix_rows(docs).count() == sum(r.taken // r["size"] for r in got if r["size"])


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(v):
    d = [int(c) for c in v if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0


PASSES = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": luhn, "phone": lambda v: 9 <= sum(map(str.isdigit, v)) <= 15}


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if PASSES[k](m[0])]


def test_personal_data(spark, odd):
    hard = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3", "é 4111 1111-1111 1111 5", "+1 () 23-", "12345678901234567890 +12345678 +123456789", "x@y a@-.-", "😀a@b.co 1.1.1.1"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(hard)], "doc_id long, text string"))
    for r, in zip(personal_data.digests(personal_data.find_personal_data(docs)).join(docs.distinct(), "doc_id").collect(), strict=True):
        want = base_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r.text[:50]
        assert set(want) <= set(filter(None, r.spans.split(",")))
    clean = {r.doc_id: r for r in personal_data.redact(odd).where("doc_id is not null").collect()}
    assert clean[12].text == "<EMAIL> x <PHONE> x <IP> x <CARD>" and clean[12].n_chars == len(clean[12].text) and clean[0].text is None


def test_bootstrap_finds_unseen(spark):
    good = [(k, f"so the account number {v} was kept", "x") for k, v in enumerate(["4111111111111111", "5500000000000004", "4012888888881881", "4222222222222220" if luhn("4222222222222220") else "4000000000000002", "4242424242424242", "5105105105105100", "6011111111111117", "3530111333300000", "6011000990139424", "4000056655665556"])]
    docs = spark.createDataFrame([*good, (50, "so the account number 4111111111111112 was kept", "x"), (51, "nothing 4111111111111113 here", "x")], "doc_id long, text string, source string")
    got = {r.doc_id: r.spans for r in personal_data.digests(personal_data.find_personal_data(docs)).collect()}
    assert got[50] == "card:22:38" and got[51] == ""


def test_bootstrap_finds_other_shapes(spark):
    phones = [f"please call +1 ({200 + k}) 555-{1000 + k} today" for k in range(12)]
    cards = [f"my visa {v} expired" for v in ("4111111111111111", "5500000000000004", "4012888888881881", "4242424242424242", "5105105105105100", "6011111111111117", "3530111333300000", "6011000990139424", "4000056655665556")]
    new = ["please call 555-123-4567 today", "please call (555) 123-4567 today", "my visa 4111 1111 1111 1112 expired", "counted 555-123-4568 and 4111 1111 1111 1113 there"]
    docs = spark.createDataFrame(list(enumerate([*new, *phones, *cards])), "doc_id long, text string")
    found = personal_data.find_personal_data(docs)
    got = {r.doc_id: r.spans for r in personal_data.digests(found).collect()}
    assert [got[k] for k in range(4)] == ["phone:12:24", "phone:12:26", "card:8:27", ""]
    assert {r.doc_id: r.text for r in personal_data.redact(docs).collect()}[2] == "my visa <CARD> expired"


def test_shards(spark, odd):
    for docs in (table(spark, SF, "documents"), odd):
        texts = collections.defaultdict(set)
        slots = collections.defaultdict(list)
        rows = docs.collect()
        got = minimax_shards(docs).collect()
        assert sorted(r["size"] for r in got) == sorted(len((x.text or "").encode()) + 16 for x in rows)
        by = {r.doc_id: r for r in got}
        for x in rows:
            texts[x.text].add(by[x.doc_id].shard)
            assert by[x.doc_id].text_crc32 == zlib.crc32((x.text or "").encode())
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(len(v) == 1 for v in texts.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) < 40


def test_capacity():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes, k = rng.integers(1, 50, 30), int(rng.integers(1, 8))
        best = {0: 0}
        table_ = np.full((k + 1, 31), 10**9)
        table_[0][0] = 0
        for s in range(1, k + 1):
            for e in range(31):
                table_[s][e] = min(max(table_[s - 1][a], sizes[a:e].sum()) for a in range(e + 1))
        assert smallest_capacity(sizes, k) == table_[k][30], best


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    special = spark.createDataFrame([(900, "a <|endoftext|> b"), (901, "two  spaces \n tab\t end "), (902, "naïve\u00a0x  \u2003 y")], "doc_id long, text string")
    docs = odd.where("doc_id is not null").select("doc_id", "text").distinct().union(special).union(table(spark, SF, "documents").where("doc_id > 20").select("doc_id", "text"))
    got = pack(docs, tokenizer_path()).collect()
    parts, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for x in docs.collect():
        ids = np.array([*tok.encode(x.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(parts[x.doc_id], key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            assert p.length == LENGTH or p.piece == 0
            at += p.length
        assert at == len(ids)
    for v in places.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= LENGTH
    total = sum(r.length for r in got)
    assert len(places) <= 1.05 * total / LENGTH + 1


def test_plan_uses_every_piece():
    rng = np.random.default_rng(8)
    histogram = np.bincount(rng.integers(1, 1024, 5000), minlength=1025)
    used = np.zeros(1025, int)
    packed = plan(histogram, 1024)
    for pattern, n in packed:
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] += n
    assert (used == histogram).all()
    assert sum(n for _, n in packed) <= 1.02 * (histogram * np.arange(1025)).sum() / 1024 + 1


def test_template_language():
    run = compile_template("{% if 1 == 1 and not false %}a{{ 'b' + 'c' }}{% else %}x{% endif %}{% for m in ms %}{% if loop.first %}^{% endif %}{{ m.t | upper }}{% generation %}{{ m.n }}{% endgeneration %}{% endfor %}")
    out = run(ms=[{"t": "q", "n": 7}, {"t": "r", "n": None}])
    assert "".join(out.parts) == "abc^Q7R" and out.marks == [(5, 6), (7, 7)]
    for bad in ("{% import os %}", "{{ x.__class__ }}", "{{ f(1) }}", "{% if a %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        compile_template("{{ secret }}")(a=1)


def test_chat(spark):
    rows = [(1, 0, "user", "[INST] hi \\[/INST]"), (1, 1, "assistant", "</s><ans>\\"), (2, 0, None, None), (2, 0, "tool>>", "<</SYS>>"), (2, 1, "assistant", ""), (None, 0, "user", "x"), (1, 1, "assistant", "</s><ans>\\")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(chat_format.with_probe(conv))
    for r in formatted.collect():
        key = lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=key)] or [("user", chat_format.PROBE), ("assistant", chat_format.PROBE)]
        assert chat_format.read_back(r.formatted) == want
        assert [chat_format.unescape(r.formatted[m.start : m.stop]) for m in r.marks] == [t for role, t in want if role == "assistant"]
    assert chat_format.digests(formatted).count() == 4


def test_rules(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    for r in with_compression_verdict(docs).collect():
        w = WORD.findall(r.text or "")
        tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[x] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert tuple(r.verdict)[:6] == want and not (want[5] and r.verdict.kept)


def test_chunks_judge_every_byte(spark):
    for n in (1, 127, 128, 255, 256, 383, 384, 2047, 2048, 3900, 4095, 4096, 5119, 5120, 6143, 20000):
        parts = chunks_of(bytes(k % 251 for k in range(n)))
        size = next(size for top, size in CHUNKS if n < top)
        assert b"".join(parts) == bytes(k % 251 for k in range(n)) and all(len(p) < 1.5 * size for p in parts)
        assert n < size or all(len(p) >= size / 2 for p in parts)
    rng = random.Random(8)
    prose = next(r.text for r in table(spark, SF, "documents").where("lang = 'en' and length(text) > 9000").orderBy("doc_id").collect() if r.text.isascii())
    noise = "".join(rng.choice([chr(k) for k in range(33, 127)]) for _ in range(1400))
    # texts below 4,096 bytes, and a tail that full chunks of CHUNK bytes do not reach
    texts = [prose[:2500] + "so it goes " * 127, prose[:2500] + noise, prose[:3900], prose[:900] + "so it goes " * 50, prose[:CHUNK * 2] + "so it goes " * 180 + noise[:60], prose[: CHUNK * 3]]
    got = with_compression_verdict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.verdict.bad_chunks > 0.3 * r.verdict.chunks for r in got} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
    assert [r.doc_id for r in sorted(got) if r.verdict.kept] == [2, 5]


def least_overlap(a, b):
    shorter = min(len(a), len(b))
    return max(1, min(audio_fingerprints.MIN_OVERLAP, shorter), math.ceil(audio_fingerprints.OVERLAP_SHARE * shorter))


def test_audio(spark):
    rng = np.random.default_rng(6)
    vectors = [(k, [float(x) for x in rng.normal(size=64)]) for k in range(60)] + [(100, [0.0] * 3), (101, []), (None, [1.0] * 64)]
    vectors.append((200, vectors[0][1]))
    got = audio_fingerprints.align_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r.match_id, r.copies, r.offset) for r in got} == {(0, 0, 2, 24), (50, 50, 1, 24), (200, 0, 2, 24)}
    assert all(r.bit_error < 0.1 for r in got)


def test_audio_recall(spark):
    """Every offset by brute force: all alignments are found, also those of queries so noisy that hardly an integer stays whole."""
    rng = np.random.default_rng(16)
    vectors = [[float(x) for x in rng.normal(size=64)] for _ in range(200)]
    held = [audio_fingerprints.fingerprint(audio_fingerprints.melody(v)) for v in vectors]
    asked = {(k, hiss): audio_fingerprints.fingerprint(audio_fingerprints.melody(vectors[k], *audio_fingerprints.QUERY_CUT, hiss=hiss)) for k in range(0, 200, 10) for hiss in (0.05, 0.5, 0.8, 1.0)}
    truth = {}
    for q, a in enumerate(asked.values()):
        for r, b in enumerate(held):
            least = least_overlap(a, b)
            for offset in range(least - len(a), len(b) - least + 1):
                i, j = max(0, -offset), min(len(a), len(b) - offset)
                error = np.bitwise_count(a[i:j] ^ b[i + offset : j + offset]).sum() / (32 * (j - i))
                if error <= audio_fingerprints.MAX_ERROR and error < truth.get((q, r), (1, 0))[0]:
                    truth[q, r] = (error, offset)
    frame = lambda prints, name: spark.createDataFrame([(k, [int(x) for x in p.view(np.int32)]) for k, p in enumerate(prints)], f"{name} long, print array<int>")
    got = {(r.query_id, r.match_id): (r.bit_error, r.offset) for r in audio_fingerprints.align(frame(asked.values(), "query_id"), frame(held, "rec_id")).collect()}
    assert len(truth) >= 80 and set(got) == set(truth)
    assert all(got[k][0] == truth[k][0] for k in truth)
    assert all(got[q, k][1] == 24 for q, (k, _) in enumerate(asked))


def test_links_sum_up_all_alignments(spark):
    """One row a recording: near copies that all ask, an equal one, lone ones, one of no fingerprint, no id and an id of two recordings."""
    rng = np.random.default_rng(18)
    some = lambda n=40: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    base = some()
    near = [base ^ np.uint32(1 << k) for k in range(5)]
    cut_short = [p[8:36] for p in near]
    sounds = [(k, p, c) for k, (p, c) in enumerate(zip(near, cut_short, strict=True))] + [(6, near[2], None), (7, some(), some()), (8, some(), None), (9, some(0), some(0)), (None, base, base), (20, a := some(), a), (20, b := some(), b), (1000, some(), base)]
    ints = lambda p: None if p is None else [int(x) for x in p.view(np.int32)]
    frame = spark.createDataFrame([(k, ints(p), ints(c)) for k, p, c in sounds], "rec_id long, print array<int>, asked array<int>")
    got = [tuple(r) for r in audio_fingerprints.links(frame).select("rec_id", "class_id", "copies", "component_id", "n_queries", "n_matches", "n_match_classes", "match_id", "offset").collect()]
    want = [(k, k, 2 if k == 2 else 1, 0, 6, 6, 5, k, 8) for k in range(5)]
    want += [(6, 2, 2, 0, 6, None, None, None, None), (7, 7, 1, 7, 0, 0, 0, None, None), (8, 8, 1, 8, 0, None, None, None, None), (9, None, None, None, 0, 0, 0, None, None), (None, None, None, None, 0, 0, 0, None, None)]
    want += [(20, 20, 1, 20, 1, 1, 1, 20, 0)] * 2 + [(1000, 1000, 1, 0, 0, 6, 5, 0, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    pairs = audio_fingerprints.align(frame.select(F.col("rec_id").alias("query_id"), F.col("asked").alias("print")), frame.select("rec_id", "print")).collect()
    assert sum(r.copies for r in pairs) == sum(r[4] for r in got) == sum(r[5] or 0 for r in got)


def test_audio_rows_grow_as_the_table(spark, tmp_path):
    """A group of near copies that all ask is one row each, not one row a pair."""
    for n in (10, 20):
        loud = np.random.default_rng(19).permutation(64).astype(float)
        vectors = [(50 * k, [float(x) for x in loud + 9 * (np.arange(64) == k + 15)]) for k in range(n)]
        spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = QUERIES["op9_audio_fingerprints"](spark, f"{tmp_path}/{n}").collect()
        pairs = audio_fingerprints.align_vectors(spark.read.parquet(f"{tmp_path}/{n}/embeddings.parquet")).collect()
        assert sorted(r.vec_id for r in got) == [v for v, _ in vectors] and {r.component_id for r in got} == {0}
        assert sum(r.n_matches for r in got) == sum(r.n_queries for r in got) == n * n == sum(r.copies for r in pairs)
        assert len(pairs) > 5 * n


def test_short_recordings_align_whole(spark):
    """Equal recordings of a few integers are one class; a shorter one lies wholly in a longer one; a null or empty one gives nothing."""
    rows = [(1, [5, 6, 7, 8, 9, 10]), (2, [5, 6, 7, 8, 9, 10]), (3, [5, 6, 7, 8, 9, 10]), (4, [-1] * 4), (5, []), (6, None), (None, [1] * 9)]
    held = spark.createDataFrame(rows, "rec_id long, print array<int>")
    asked = spark.createDataFrame([(8, [5, 6, 7, 8, 9, 10]), (9, [-1, -1])], "query_id long, print array<int>")
    got = {(r.query_id, r.match_id): (r.copies, r.offset, r.bit_error) for r in audio_fingerprints.align(asked, held).collect()}
    assert got[8, 1] == (3, 0, 0.0) and (9, 4) in got and not {m for _, m in got} & {2, 3, 5, 6, None}


def test_audio_lengths(spark, monkeypatch):
    """Queries of several lengths and a recording longer than one transform: the same alignments as by brute force."""
    rng = np.random.default_rng(17)
    held = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (5000, 9, 40, 1, 1500)]
    asked = [held[0][4321:4400], held[4][3:900], held[1], held[2][:20], rng.integers(0, 1 << 32, 30, dtype=np.uint32)]
    sizes = lambda parts: np.array([len(p) for p in parts])
    want = set()
    for q, a in enumerate(asked):
        for r, b in enumerate(held):
            least = least_overlap(a, b)
            for offset in range(least - len(a), len(b) - least + 1):
                i, j = max(0, -offset), min(len(a), len(b) - offset)
                differ = int(np.bitwise_count(a[i:j] ^ b[i + offset : j + offset]).sum())
                if differ <= 8 * (j - i):
                    want.add((q, r, offset, 32 * (j - i) - differ))
    for at_once in (1 << 10, 1 << 18):
        monkeypatch.setattr(audio_fingerprints, "ASKED_AT_ONCE", at_once)
        got = audio_fingerprints._search(np.concatenate(asked), sizes(asked), np.concatenate(held), sizes(held))
        assert {(int(q), int(r), int(o), int(v)) for part in got for q, r, o, v in zip(*part[:4], strict=True)} == want
    assert {(0, 0, 4321), (1, 4, 3), (2, 1, 0), (3, 2, 0)} <= {w[:3] for w in want}


def test_language_model(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd.where("doc_id is null or doc_id >= 0").select(F.col("doc_id") + 10000, "text"))
    count = collections.Counter()
    rows = docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    crc = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5
    for r in rows:
        if crc(r.doc_id) != 1:
            count.update(tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = collections.Counter((r.doc_id, crc(r.doc_id) == 1, len(tokens(r.text)), sum(count[t] > 0 for t in tokens(r.text)), n, round(sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r.text)), 4)) for r in rows)
    got = context_mixing.context_mixing_scores(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert all(r.bits_per_byte is None or r.bits_per_byte > 0 for r in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES[name](spark, str(tmp_path)).count()
    assert got == (1 if name.startswith("op7") else 0)
