"""Quality grades: an ordinal cumulative-link (proportional-odds) regression on hashed text.

``P(grade <= k | text) = sigmoid(theta_k - f(text))`` with one weight vector
shared by all grades and ordered thresholds ``theta``. The features are
frequencies, within the text, of hashed words, word endings, outer-character
classes, and word lengths, so a long text weighs no more than a short one, and
one bucket each of the text's length and of its share of distinct words. Grades are the distinct ratings found, in their
order (two make it a plain logistic regression). AdaGrad passes run over a
bounded sample of labelled rows in one task; the weights are broadcast.

Results: ``expected_grade`` is the mean grade, ``tail_prob`` the probability of
a grade of at least ``cut``. Ratings may be fractions. Cases: a null text is an empty one; without usable
ratings every text has tail probability 1 (nothing is rejected); a document rated
more than once has its largest rating, and a rating that is null or NaN none;
repeated rows each get their row (and count once in training); a tail
probability of exactly the cut counts as reached; very long texts are judged
whole, alone in their run, and are too long to train on beyond a sixteenth of
``train_bytes``; an empty table gives an empty result; other columns pass through untouched.
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


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    train_rows: int = 8_000
    train_bytes: int = 64 << 20
    epochs: int = 6
    rate: float = 0.5
    l2: float = 1e-5
    seed: int = 29


_CLASS = np.full(256, 5, dtype=np.uint64)  # other bytes of a UTF-8 letter
_CLASS[list(range(97, 123))] = 0
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[list(b".,;:?!'\"()-")] = 3
_CLASS[list(b"#*$%&|<>@^~_=+/\\[]{}`")] = 4


_SIZES, _AGAIN = 21, 16  # buckets of length, and of the share of distinct features


def occurrences(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the four views of each word."""
    raw, s, e = words.raw, words.starts, words.ends
    first, last = raw[s], raw[e - 1]
    before = raw[np.maximum(e - 2, s)]
    length = np.minimum(e - s, 40).astype(np.uint64)
    view = lambda tag, *parts: mix(sum((p.astype(np.uint64) << np.uint64(8 * i) for i, p in enumerate(parts)), np.full(len(s), tag << 56, np.uint64)))
    found = [
        words.hash,
        view(1, last, before),
        view(2, _CLASS[first], _CLASS[raw[np.minimum(s + 1, e - 1)]], _CLASS[before], _CLASS[last]),
        view(3, length),
    ]
    return np.tile(words.doc, 4), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def matrix(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (text, slot, value): frequencies in the text, and the buckets of length and repetition."""
    doc, slot = occurrences(words, bits)
    keys, counts = np.unique((doc.astype(np.int64) << bits) | slot, return_counts=True)
    n = np.bincount(words.doc, minlength=words.n_docs)
    rows = keys >> bits
    size = np.minimum(np.log2(n + 1).astype(np.int64), _SIZES - 1)
    different = np.bincount(rows, minlength=words.n_docs) / np.maximum(4 * n, 1)
    again = np.minimum((np.maximum(np.log2(np.maximum(different, 1e-3)) + 8, 0) * 2).astype(np.int64), _AGAIN - 1)
    every = np.arange(words.n_docs)
    return (
        np.concatenate([rows, every, every]),
        np.concatenate([keys & ((1 << bits) - 1), (1 << bits) + size, (1 << bits) + _SIZES + again]),
        np.concatenate([np.sqrt(counts / n[rows]), np.full(words.n_docs, 0.2), np.full(words.n_docs, 0.5)]),
    )


def WIDTH(bits: int) -> int:
    return (1 << bits) + _SIZES + _AGAIN


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    bits: int
    grades: tuple[float, ...]
    theta: np.ndarray
    weight: np.ndarray

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, words in chunks(texts):
            r, c, v = matrix(words, self.bits)
            out[first : first + words.n_docs] = np.bincount(r, weights=v * self.weight[c], minlength=words.n_docs)
        return out

    def judge(self, texts: list[str | None], cut: float) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of a grade of ``cut`` or more) of each text."""
        if not self.grades:
            return np.zeros(len(texts)), np.ones(len(texts))
        below = _sigmoid(self.theta[None, :] - self.latent(texts)[:, None])
        edge = np.concatenate([np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))], axis=1)
        each = np.diff(edge, axis=1)
        grades = np.array(self.grades)
        return each @ grades, each[:, grades >= cut].sum(axis=1)


Row = tuple[np.ndarray, np.ndarray]


def sparse_rows(texts: list[str | None], bits: int) -> list[Row]:
    """(slots, values) of each text, in narrow types: the sample's rows are all held at once."""
    rows: list[Row] = []
    for _, words in chunks(texts):
        r, c, v = matrix(words, bits)
        order = np.argsort(r, kind="stable")
        cut = np.searchsorted(r[order], np.arange(words.n_docs + 1))
        rows += [(c[order[a:b]].astype(np.int32), v[order[a:b]].astype(np.float32)) for a, b in zip(cut[:-1], cut[1:])]
    return rows


def slopes(f: float, theta: np.ndarray, y: int) -> tuple[float, float, np.ndarray]:
    """Of one text of latent value ``f`` and grade number ``y``: its probability, and the slopes of
    minus its log likelihood by ``f`` and by each threshold."""
    k = len(theta)
    hi = _sigmoid(theta[y] - f) if y < k else 1.0
    lo = _sigmoid(theta[y - 1] - f) if y > 0 else 0.0
    p, dh, dl = max(hi - lo, 1e-9), hi * (1 - hi), lo * (1 - lo)
    d = np.zeros(k)
    if y < k:
        d[y] -= dh / p
    if y > 0:
        d[y - 1] += dl / p
    return p, (dh - dl) / p, d


def train(rows: list[Row], ratings: list[float], s: Settings) -> Model:
    """AdaGrad on the cumulative-link likelihood; gaps between thresholds stay positive by their logarithm."""
    grades = tuple(sorted(set(ratings)))
    if not grades:
        return Model(s.bits, (), np.zeros(0), np.zeros(WIDTH(s.bits)))
    number = {g: i for i, g in enumerate(grades)}
    y = [number[x] for x in ratings]
    k = len(grades) - 1
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y)
    theta = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    head = theta[:1].copy()
    gap = np.log(np.maximum(np.diff(theta), 1e-3))
    w, g2 = np.zeros(WIDTH(s.bits)), np.full(WIDTH(s.bits), 1e-4)
    t2 = np.full(k, 1.0)
    for epoch in range(s.epochs if k else 0):
        for i in np.random.default_rng(s.seed + epoch).permutation(len(rows)):
            c, v = rows[i]
            theta = np.concatenate([head, head + np.cumsum(np.exp(gap))])
            _, df, d = slopes(float((w[c] * v).sum()), theta, y[i])
            g = df * v + s.l2 * w[c]
            g2[c] += g * g
            w[c] -= s.rate * g / np.sqrt(g2[c])
            d = np.concatenate([[d.sum()], np.cumsum(d[::-1])[::-1][1:] * np.exp(gap)])
            t2 += d * d
            step = 0.3 * d / np.sqrt(t2)
            head, gap = head - step[:1], gap - step[1:]
    theta = np.concatenate([head, head + np.cumsum(np.exp(gap))]) if k else np.zeros(0)
    return Model(s.bits, grades, theta, w)


def fit(docs: DataFrame, labels: DataFrame, rating: str = "quality", settings: Settings = Settings()) -> Model:
    """Train on at most ``settings.train_rows`` rated rows that are not held out; at most 2**bits weights come back."""

    def trained(batches):
        rows, ratings = [], []
        for b in batches:  # in order; only the features of each batch are kept
            rows += sparse_rows(b.column("text").to_pylist(), settings.bits)
            ratings += b.column("y").to_pylist()
        m = train(rows, ratings, settings)
        del rows
        give_back()
        at = np.flatnonzero(m.weight)
        for kind, k, v in (("g", np.arange(len(m.grades)), np.array(m.grades, float)), ("t", np.arange(len(m.theta)), m.theta), ("w", at, m.weight[at])):
            yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(k), pa.string()), "k": pa.array(k, pa.int64()), "v": pa.array(v, pa.float64())})

    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, rating, settings.train_rows, settings.train_bytes, settings.seed)
    got = sample.mapInArrow(trained, "kind string, k long, v double").toArrow()
    kind, k, v = (got.column(c).to_numpy() for c in ("kind", "k", "v"))
    part = lambda x: v[kind == x][np.argsort(k[kind == x])]
    weight = np.zeros(WIDTH(settings.bits))
    weight[k[kind == "w"]] = v[kind == "w"]
    return Model(settings.bits, tuple(float(g) for g in part("g")), part("t"), weight)


def grade(text: Column, model: Model, cut: float, spark) -> Column:
    """``struct<expected_grade, tail_prob>`` of a text column."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("expected_grade double, tail_prob double")
    def graded(texts: pa.Array) -> pa.Array:
        mean, tail = held.value.judge(texts.to_pylist(), cut)
        give_back()
        return pa.StructArray.from_arrays([pa.array(mean), pa.array(tail)], names=["expected_grade", "tail_prob"])

    return graded(text)
