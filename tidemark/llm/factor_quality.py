"""Quality score by a factorisation machine over hashed words, structure statistics and size classes.

score = sigmoid(b + sum w_i x_i + pairs), pairs = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairwise interactions in
time linear in the features. Statistics of the text (shares of capitals, symbols, digits, repeats ...) are one-hot by bin, words are hashed;
language, source, ids and labels are no features. The machine is fitted on a sample of about ``SAMPLE`` labelled rows (a share of the hashes of
their ids; twice as many at most) and scores every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold
from tidemark.llm.textkernel import Words, batches, windows

WORD_BITS, FACTORS = 15, 8
SAMPLE, EPOCHS, RATE, DECAY = 8000, 6, 0.08, 2e-5
BINS = 12
_EDGES = np.array([0.0005, 0.002, 0.006, 0.015, 0.03, 0.06, 0.12, 0.22, 0.38, 0.6, 0.85])
#: Statistics, in the order of `_statistics`; sizes are log classes, the others are shares in 0..1.
STATISTICS = ("words", "bytes", "word_length", "lines", "line_words", "upper", "symbol", "digit", "stop", "bang", "pipe", "beyond_ascii", "few_distinct", "repeats", "equal_lines", "same_next")
WORD_BASE = len(STATISTICS) * BINS
FEATURES = WORD_BASE + (1 << WORD_BITS)


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL, _STOP, _DIGIT = _flags(b"#*$%&<>"), _flags(b".,;:?"), _flags(b"0123456789")


def _log_bin(value: float, step: float) -> int:
    return int(min(BINS - 1, np.log2(value + 1) / step))


def _share_bin(value: float) -> int:
    return int(np.searchsorted(_EDGES, value, "right"))


def features(words: Words, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one document's features."""
    raw = words.raw[words.offsets[d] : words.offsets[d + 1]]
    hashes = words.hash[words.first[d] : words.first[d + 1]]
    n, size = len(hashes), max(1, len(raw))
    lines = words.text(d).split(b"\n")
    distinct, counts = np.unique(hashes, return_counts=True)
    tri = windows(hashes, 3)
    share = lambda flags: float(np.count_nonzero(flags)) / size
    stats = [
        _log_bin(n, 1.2), _log_bin(len(raw), 1.4), _log_bin(size / max(1, n), 0.45), _log_bin(len(lines), 1.0), _log_bin(n / len(lines), 0.9),
        _share_bin(share((raw >= 65) & (raw <= 90))), _share_bin(share(_SYMBOL[raw])), _share_bin(share(_DIGIT[raw])), _share_bin(share(_STOP[raw])),
        _share_bin(share(raw == 33)), _share_bin(share(raw == 124)), _share_bin(share(raw >= 128)), _share_bin(1 - len(distinct) / max(1, n)),
        _share_bin(1 - len(np.unique(tri)) / max(1, len(tri))), _share_bin(1 - len(set(lines)) / len(lines)), _share_bin(float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0),
    ]
    index = np.concatenate([np.arange(len(stats)) * BINS + stats, WORD_BASE + (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)])
    tf = 1 + np.log(counts)
    value = np.concatenate([np.full(len(stats), 0.5), tf / max(1e-9, np.sqrt((tf * tf).sum()))])
    # words that share a bucket are one feature: else the identity would miss their square
    index, place = np.unique(index, return_inverse=True)
    return index, np.bincount(place, value, len(index))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factor[index] * value[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.weight[index] @ value + 0.5 * (s @ s - (v * v).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Machine:
    """Logistic loss, AdaGrad, one row at a time in a fixed shuffled order. Without both classes: a constant."""
    rng = np.random.default_rng(11)
    labels = np.array([y for *_, y in rows], float)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(FEATURES), rng.normal(0, 0.03, (FEATURES, FACTORS)))
    if len(set(labels)) < 2:
        return Machine(m.bias, m.weight, m.factor * 0)
    gw, gv, gb = np.full(FEATURES, 1e-3), np.full((FEATURES, FACTORS), 1e-3), 1e-3
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value, y = rows[k]
            v = m.factor[index]
            s = value @ v
            z = m.bias + m.weight[index] @ value + 0.5 * (s @ s - ((v * value[:, None]) ** 2).sum())
            g = 1 / (1 + np.exp(-z)) - y
            dw = g * value + DECAY * m.weight[index]
            dv = g * (value[:, None] * s - v * (value * value)[:, None]) + DECAY * v
            gw[index] += dw * dw
            gv[index] += dv * dv
            gb += g * g
            m.weight[index] -= RATE * dw / np.sqrt(gw[index])
            m.factor[index] -= RATE * dv / np.sqrt(gv[index])
            m.bias -= RATE * g / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on about ``sample`` labelled rows outside the held-out fold; they alone come to the driver."""
    chosen = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != 0)
    share = min(1.0, sample / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * sample).select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))

    @F.arrow_udf("index array<int>, value array<double>")
    def extract(texts: pa.Array) -> pa.Array:
        rows = [features(w, d) for _, _, w in batches(texts) for d in range(len(w))]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["index", "value"])

    # the sample is bounded, so it may be sent to every task
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    got = joined.select("doc_id", "quality", extract("text").alias("x")).limit(4 * sample).toPandas()
    got = got.sort_values(["doc_id", "quality"], kind="stable") if len(got) else got
    return fit([(np.asarray(x["index"], np.int64), np.asarray(x["value"], float), int(y)) for x, y in zip(got["x"], got["quality"], strict=True)]) if len(got) else fit([])


def with_quality(docs: DataFrame, machine: Machine, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the score of every whole text, 0 to 1. Null text counts as empty, and the empty text has a score like any other."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32)))  # of fixed size

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        m = Machine(*sent.value)
        z = [m.raw(*features(w, d)) for _, _, w in batches(texts) for d in range(len(w))]
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40))), pa.float64())

    return docs.withColumn(column, score.asNondeterministic()(F.col(text).cast("string")))


def held_out_report(scored: pd.DataFrame, threshold: float = 0.3) -> dict[str, float]:
    """Accuracy and rank quality of ``score`` against ``quality``."""
    y, s = scored["quality"].to_numpy(), scored["score"].to_numpy()
    order = s.argsort(kind="stable").argsort(kind="stable") + 1
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    auc = (order[y == 1].sum() - pos * (pos + 1) / 2) / max(1, pos * neg)
    return {"accuracy": float(((s >= threshold) == (y == 1)).mean()), "auc": float(auc), "rows": len(y)}
