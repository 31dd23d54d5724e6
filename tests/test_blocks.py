"""Posting lists of blocks of entries against whole tables of sums."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import posting_blocks


def _asked_and_entries(n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)])
    share = 1 / np.arange(1, 401)
    draw = lambda k: words[rng.choice(400, k, p=share / share.sum())].tolist()
    texts = [draw(int(k)) for k in rng.integers(0, 60, n)]
    asked = [(q, token, token != "waa", 1.0 + q % 2) for q in range(40) for token in set(draw(9))]
    return texts, pa.table([pa.array(c) for c in zip(*asked, strict=True)], names=["question_id", "token", "word", "weight"])


@pytest.mark.parametrize("n", [0, 300, 9000])
def test_blocks_give_the_first_of_a_whole_table(n):
    """Lists that cannot reach the least score are only looked up, whatever the block; the first rows are those of all sums."""
    texts, rows = _asked_and_entries(n)
    asked = posting_blocks.Asked.of(rows)
    size = len(asked.vocabulary)
    place = {w: k for k, w in enumerate(asked.vocabulary.to_pylist())}
    part = lambda tf, dl: tf * 2.5 / (tf + 0.5 + dl / 30)
    kept = {kind: posting_blocks.Firsts(k) for kind, k in (("best", 7), ("newest", 5), ("most", 4), ("holding", 6))}
    is_word = np.zeros(size, bool)
    for words in asked.words:
        is_word[words] = True
    blocks = posting_blocks.Blocks(asked.vocabulary, part)
    entries = pa.array([[{"dl": len(t), "tokens": t}] for t in texts], pa.list_(pa.struct([("dl", pa.int32()), ("tokens", pa.list_(pa.string()))])))
    ids = np.random.default_rng(5).permutation(n)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids // 3, pa.int64()), entries], names=["entry_id", "created_at", "parts"])
    made = [block for k in range(0, n, 4000) for block in blocks.add(batch.slice(k, 4000))] + ([blocks.rest()] if blocks.held else [])
    for block in made:
        posting_blocks._add(kept, asked, block, is_word)

    tf = np.zeros((size, n), np.int64)
    for row, text in enumerate(texts):
        for token in text:
            if token in place:
                tf[place[token], row] += 1
    parts = part(tf, np.array([len(t) for t in texts], float))
    first = lambda by, rows, k: [int(ids[r]) for r in sorted(rows, key=lambda r: (-by[r], ids[r]))[:k]]
    for q in range(len(asked.questions)):
        raw = (asked.weights[q][:, None] * parts[asked.codes[q]]).sum(axis=0)
        all_words = np.flatnonzero((tf[asked.words[q]] > 0).all(axis=0))
        for kind, by, some, k in (("best", np.round(raw, 6), np.flatnonzero(raw), 7), ("newest", ids // 3, all_words, 5), ("holding", tf[asked.words[q]].sum(axis=0), all_words, 6)):
            found = kept[kind].rows.get(q)
            assert ([] if found is None else found[1].tolist()) == first(by, some, k), (kind, q)
    for code in range(size):
        found = kept["most"].rows.get(code)
        assert ([] if found is None else found[1].tolist()) == (first(tf[code], np.flatnonzero(tf[code]), 4) if is_word[code] else [])


def test_frequent_tokens_are_not_read_whole():
    """A question with a rare token scores few of the entries that hold its frequent ones."""
    n = 20000
    one = np.zeros(n, np.int64)
    rare = np.arange(0, n, 2000)
    block = posting_blocks.Block(np.arange(n), one, one + 10, np.concatenate([np.arange(n), rare]).astype(np.int32), np.concatenate([one, np.ones(len(rare), int)]).astype(np.int32), 2, lambda tf, dl: tf * 1.0)
    rows, sums = block.reaching(np.array([0, 1]), np.array([0.1, 5.0]), 1.0)
    assert rows.tolist() == rare.tolist() and sums.tolist() == [5.1] * len(rare)
    assert not len(block.reaching(np.array([0]), np.array([0.1]), 1.0)[0])
