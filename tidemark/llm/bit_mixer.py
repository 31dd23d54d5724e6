"""Logistic mixing of bit predictors whose contexts are hashed into tables of counters.

Every decision is one bit at a node of a code tree. Each context, hashed with the node, names a pair of counters (zeros, ones seen). A
counter pair becomes a stretched probability by a table of what such pairs turned out to mean; a weight vector, chosen by a gate, mixes
the contexts; an adaptive map of (gate, mixed probability) refines the result. Weights, table and map are learned online, step by step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_U = np.uint64
_SPREAD, _TURN = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Counts are kept as bytes on a logarithmic scale; below 9 they are exact.
SCALE = 8.5
VALUE = np.rint(np.expm1(np.arange(256) / SCALE))
_EDGES = (0.5, 1.5, 2.5, 3.5, 5.5, 8.5, 12.5, 20.5, 36.5, 72.5, 150, 400, 1500, 8000, 100000)
CLASSES = len(_EDGES) + 1
MANY = 400  # a pair that saw more bits speaks for itself
STEPS = 33
#: Bits that one online step takes together, and how far it goes.
CHUNK, RATE = 1 << 14, 0.02


def packed(counts: np.ndarray) -> np.ndarray:
    return np.rint(np.log1p(counts) * SCALE).clip(0, 255).astype(np.uint8)


_CLASS = np.digitize(VALUE, _EDGES)
_ZEROS, _ONES = np.divmod(np.arange(65536), 256)
CELL = (_CLASS[_ZEROS] * CLASSES + _CLASS[_ONES]).astype(np.int64)
_TOTAL = VALUE[_ZEROS] + VALUE[_ONES]
_RATIO = np.log((VALUE[_ONES] + 0.05) / (VALUE[_ZEROS] + 0.05))
#: How much a pair has seen, in four grades.
TRUST = np.digitize(_TOTAL, (0.5, 6, 60)).astype(np.int64)
_LESS = packed(np.maximum(0, VALUE - 1))
#: The pair without the bit at hand: LESS[bit, pair].
LESS = np.stack([_LESS[_ZEROS].astype(np.uint16) * 256 + _ONES.astype(np.uint16), _ZEROS.astype(np.uint16) * 256 + _LESS[_ONES]]).astype(np.uint16)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def place(context: np.ndarray | None, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of (context, node) in a table of 2 ** bits; without a context the node itself is the slot."""
    if context is None:
        return node.astype(np.int64)
    return ((context + node.astype(_U) * _SPREAD) * _TURN >> _U(64 - bits)).view(np.int64)


@dataclass
class Mixer:
    """``bits``: log2 of the slots of each context. The last two contexts, by how much they saw, are part of the gate."""

    bits: tuple[int, ...]
    gates: int = 3
    pairs: list[np.ndarray] = field(default_factory=list)  # counter pairs of each context: zeros * 256 + ones, packed
    meaning: np.ndarray | None = None  # contexts x classes of pairs: stretched probability of a one
    weights: np.ndarray | None = None  # sets x contexts
    refine: np.ndarray | None = None  # sets x STEPS

    def __post_init__(self) -> None:
        n, sets = len(self.bits), self.gates * 16
        if not self.pairs:
            self.pairs = [np.zeros(1 << b, np.uint16) for b in self.bits]
        if self.meaning is None:
            typical = np.array([VALUE[_CLASS == c].min() for c in range(CLASSES)])
            self.meaning = np.tile(np.log((typical[None, :] + 0.3) / (typical[:, None] + 0.3)).reshape(-1), (n, 1))
            self.weights = np.full((sets, n), 1.0 / n)
            self.refine = np.tile(np.arange(STEPS) / 2 - 8, (sets, 1))
        self.settle()

    def settle(self) -> None:
        """Bring the meaning of every pair up to date."""
        self.map = self.refine.reshape(-1).astype(np.float32)
        own = np.where(_TOTAL < MANY, self.meaning[:, CELL], _RATIO[None, :])
        self.meant = np.clip(own, -8, 8).astype(np.float32)

    def look(self, slots: list[np.ndarray], seen: np.ndarray | None = None) -> list[np.ndarray]:
        """The counter pairs; with ``seen``, the bits, each without its own occurrence."""
        pairs = [table.take(at) for table, at in zip(self.pairs, slots, strict=True)]
        return pairs if seen is None else [LESS.reshape(-1).take(p + seen.astype(np.int64) * 65536) for p in pairs]

    def gate(self, base: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        return base * 16 + TRUST.take(pairs[-1]) * 4 + TRUST.take(pairs[-2])

    def mix(self, pairs: list[np.ndarray], gate: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        inputs = [self.meant[k].take(p) for k, p in enumerate(pairs)]
        x = np.zeros(len(gate), np.float32)
        for k, st in enumerate(inputs):
            x += self.weights[:, k].astype(np.float32).take(gate) * st
        return inputs, x

    def refined(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretched result, lower step of the map, share of the upper one)."""
        at = (np.clip(x, -7.999, 7.999) + np.float32(8)) * np.float32(2)
        step = at.astype(np.int64)
        share = at - step
        cell = gate * STEPS + step
        flat = self.map
        low = flat.take(cell)
        return 0.5 * (np.clip(x, -12, 12) + low + (flat.take(cell + 1) - low) * share), cell, share

    def cost(self, slots: list[np.ndarray], bit: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each bit."""
        out = np.empty(len(bit), np.float32)
        for k in range(0, len(bit), CHUNK):
            pairs = self.look([s[k : k + CHUNK] for s in slots])
            gate = self.gate(base[k : k + CHUNK], pairs)
            y = self.refined(self.mix(pairs, gate)[1], gate)[0]
            out[k : k + CHUNK] = -np.log1p(np.exp(np.where(bit[k : k + CHUNK], -y, y)))
        return out


class Lesson:
    """What one task learns: a mixer that moves along, and the sums that put the mixers of all tasks together."""

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        n, sets = mixer.meaning.shape[0], len(mixer.weights)
        self.seen = np.full((n, CLASSES * CLASSES), 2.0)
        self.ones = self.seen * squash(mixer.meaning)
        self.map_seen = np.full(sets * STEPS, 40.0)
        self.map_ones = self.map_seen * squash(mixer.refine.reshape(-1))
        self.start = [x.copy() for x in (self.seen, self.ones, self.map_seen, self.map_ones)]
        self.heft = np.zeros(sets)
        self.path = np.zeros_like(mixer.weights)

    def learn(self, slots: list[np.ndarray], bit: np.ndarray, base: np.ndarray) -> None:
        """Predict a chunk, each bit from what the others showed; then move towards what came."""
        m = self.mixer
        for k in range(0, len(bit), CHUNK):
            b, part = bit[k : k + CHUNK], [s[k : k + CHUNK] for s in slots]
            pairs = m.look(part, b)
            gate = m.gate(base[k : k + CHUNK], pairs)
            inputs, x = m.mix(pairs, gate)
            miss = b - squash(np.clip(x, -12, 12))
            n = np.bincount(gate, minlength=len(m.weights))
            here = np.flatnonzero(n)
            root = np.sqrt(n[here] / (1 + 0.02 * np.sqrt(self.heft[here])))
            for c, st in enumerate(inputs):
                m.weights[here, c] += RATE * (np.bincount(gate, miss * st, len(m.weights))[here] / n[here]) * root
                self.path[:, c] += n * m.weights[:, c]
            self.heft += n
            _, cell, share = m.refined(x, gate)
            cell = np.where(share < 0.5, cell, cell + 1)
            self.map_seen += np.bincount(cell, minlength=len(self.map_seen))
            self.map_ones += np.bincount(cell, b, len(self.map_ones))
            for c, p in enumerate(pairs):
                at = CELL.take(p)
                self.seen[c] += np.bincount(at, minlength=CLASSES * CLASSES)
                self.ones[c] += np.bincount(at, b, CLASSES * CLASSES)
        m.refine = stretch(np.clip(self.map_ones / self.map_seen, 3e-5, 1 - 3e-5)).reshape(m.refine.shape)
        m.meaning = stretch(np.clip(self.ones / self.seen, 3e-5, 1 - 3e-5))
        m.settle()

    def sums(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ones, seen) of the meanings and of the map, and (weights along the way, bits)."""
        a, b, c, d = self.start
        return [((self.ones - b).reshape(-1), (self.seen - a).reshape(-1)), (self.map_ones - d, self.map_seen - c), (self.path.reshape(-1), np.repeat(self.heft, self.path.shape[1]))]


def combined(mixer: Mixer, sums: list[tuple[np.ndarray, np.ndarray]]) -> Mixer:
    """The mixer of all lessons: counts add up, weights are the mean of where they went."""
    start = Lesson(mixer)
    (ones, seen), (map_ones, map_seen), (path, heft) = sums
    meaning = stretch(np.clip((start.ones + ones.reshape(start.ones.shape)) / (start.seen + seen.reshape(start.seen.shape)), 3e-5, 1 - 3e-5))
    refine = stretch(np.clip((start.map_ones + map_ones) / (start.map_seen + map_seen), 3e-5, 1 - 3e-5)).reshape(mixer.refine.shape)
    weights = np.where(heft > 0, path / np.maximum(heft, 1), mixer.weights.reshape(-1)).reshape(mixer.weights.shape)
    return Mixer(mixer.bits, mixer.gates, mixer.pairs, np.round(meaning, 6), np.round(weights, 6), np.round(refine, 6))
