"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased over A-Z and end at ASCII white space. Features are the
*presence* of words, word pairs, and pairs that skip one or two words, hashed
into ``2**bits`` slots. Training runs the per-coordinate FTRL-proximal update
(one learning rate for each slot, L1 threshold on its accumulated gradient) over
a bounded sample of labelled rows in one task; what L1 leaves is a few thousand
weights at most ``2**bits``, which are broadcast for scoring.

Cases: a null text scores as an empty one, which gets the bias alone; without
any usable label every score is 0.5, ``predicted`` is 1, and the model is not ``trained``; a
document labelled more than once has its largest label; repeated rows each get their row (and count
once in training); a score of exactly 0.5 is predicted toxic; very long texts are scored whole, alone in their run, and are
too long to train on beyond a sixteenth of ``train_bytes``; an empty table gives an empty
result; other columns of the input pass through ``score`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.hashing import Words, chunks, mix
from quarry.llm.labelled import give_back, training_rows
from quarry.session import small_batches

_PAIR = [(np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F + 2 * k), 1 + k) for k in range(3)]


@dataclass(frozen=True)
class Settings:
    """``train_rows`` and ``train_bytes`` bound the labelled sample; ``toxic_passes`` is how often an epoch
    shows each toxic row (they are the rarer class); the rest are FTRL's own parameters."""

    bits: int = 20
    train_rows: int = 12_000
    train_bytes: int = 64 << 20
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 0.5
    l1: float = 4.0
    l2: float = 0.01
    toxic_passes: int = 3
    seed: int = 17


def slots(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each feature occurrence: words, neighbours, and pairs over one or two skipped words."""
    shift = np.uint64(64 - bits)
    docs, found = [words.doc], [words.hash >> shift]
    for a, b, gap in _PAIR:
        same = words.doc[:-gap] == words.doc[gap:]
        docs.append(words.doc[:-gap][same])
        found.append(mix(words.hash[:-gap][same] * a + words.hash[gap:][same] * b) >> shift)
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def features(texts: list[str | None], bits: int) -> list[np.ndarray]:
    """The distinct slots of each text."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
    for first, words in chunks(texts):
        doc, slot = slots(words, bits)
        keys = np.unique((doc.astype(np.int64) << bits) | slot)
        cut = np.searchsorted(keys, np.arange(words.n_docs + 1, dtype=np.int64) << bits)
        for i in range(words.n_docs):
            out[first + i] = (keys[cut[i] : cut[i + 1]] & ((1 << bits) - 1)).astype(np.int32)
    return out


def recurring(rows: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Leave out the slots that only one text of the sample has; nothing can be learnt from those."""
    seen = np.zeros(1 << bits, dtype=np.int64)
    for r in rows:
        seen[r] += 1
    for i, r in enumerate(rows):  # in place, so that the two are never held side by side
        rows[i] = r[seen[r] > 1]
    return rows


class FTRL:
    """The per-coordinate FTRL-proximal learner; slot ``2**bits`` is the bias, free of L1."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == (1 << s.bits), 0.0, s.l1)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, 1 << self.s.bits)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[np.ndarray], ys: list[int]) -> FTRL:
        turns = np.repeat(np.arange(len(rows)), [self.s.toxic_passes if y else 1 for y in ys])
        for epoch in range(self.s.epochs):
            for i in np.random.default_rng(self.s.seed + epoch).permutation(turns):
                self.learn(rows[i], ys[i])
        return self


@dataclass(frozen=True)
class Model:
    """Slots with a weight other than zero, their weights, the bias, and whether there was a row to learn from."""

    bits: int
    slot: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool = True

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.slot):
            there = np.zeros(1 << self.bits, dtype=bool)
            there[self.slot] = True
            for first, words in chunks(texts):
                doc, slot = slots(words, self.bits)
                hit = there[slot]
                keys = np.unique((doc[hit].astype(np.int64) << self.bits) | slot[hit])
                w = self.weight[np.searchsorted(self.slot, keys & ((1 << self.bits) - 1))]
                out[first : first + words.n_docs] += np.bincount(keys >> self.bits, weights=w, minlength=words.n_docs)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Train on at most ``settings.train_rows`` labelled rows that are not held out."""

    def train(batches):
        rows, ys = [], []
        for b in batches:  # in order; only the features of each batch are kept
            rows += features(b.column("text").to_pylist(), settings.bits)
            ys += [int(y > 0) for y in b.column("y").to_pylist()]
        if not rows:
            return
        learner = FTRL(settings).fit(recurring(rows, settings.bits), ys)
        every = np.arange((1 << settings.bits) + 1)
        w = learner.weights(every)
        keep = every[(w != 0) | (every == 1 << settings.bits)]
        del rows, learner
        give_back()
        yield pa.RecordBatch.from_pydict({"slot": pa.array(keep, pa.int64()), "weight": pa.array(w[keep], pa.float64())})

    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, label, settings.train_rows, settings.train_bytes, settings.seed)
    got = sample.mapInArrow(train, "slot long, weight double").collect()
    found = {r.slot: r.weight for r in got}
    bias = found.pop(1 << settings.bits, 0.0)
    slot = np.array(sorted(found), dtype=np.int64)
    return Model(settings.bits, slot, np.array([found[k] for k in slot.tolist()], dtype=np.float64), bias, bool(got))


def score(text: Column, model: Model, spark) -> Column:
    """The toxicity of a text column, 0 to 1."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = pa.array(held.value.scores(texts.to_pylist()), pa.float64())
        give_back()
        return out

    return scored(text)
