"""The methods of single operators beside plain versions of themselves."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann_search, quality_classifier, quality_rules, sharding, toxicity
from quarry.llm.labelled import held_out, training_rows

# 4


@pytest.mark.parametrize("seed", range(5))
def test_placing_against_a_plain_greedy(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 5, 24])
    units = [[rng.choice([0.0, rng.random(), rng.random() ** 6]) for _ in range(3)] for _ in range(rng.choice([1, 30, 400]))]
    left, want = [[1.0] * 3 for _ in range(shards)], [None] * len(units)
    for i in sorted(range(len(units)), key=lambda i: -max(units[i])):
        dots = [sum(a * b for a, b in zip(x, units[i])) for x in left]
        best = max(range(shards), key=lambda s: (round(dots[s], 12), -s))
        want[i] = best
        left[best] = [a - b for a, b in zip(left[best], units[i])]
    got, rest = sharding.greedy(np.array(units), shards)
    assert got.tolist() == want and np.allclose(rest, left)
    placed = sharding.place(np.array(units), shards)
    load = np.bincount(placed, weights=np.array(units)[:, 0], minlength=shards)
    high, low = load.argmax(), load.argmin()
    gap = load[high] - load[low]
    assert gap <= np.ptp(np.bincount(want, weights=np.array(units)[:, 0], minlength=shards)) + 1e-9
    assert not any(1e-9 < u[0] < gap - 1e-6 for u, s in zip(units, placed) if s == high)  # no single move would help


# 8


def test_ftrl_against_plain_loops():
    s = toxicity.Settings(bits=8, l1=0.3, alpha=0.7, beta=0.4, l2=0.05)
    rng = random.Random(2)
    learner, z, n = toxicity.FTRL(s), {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        l1 = 0.0 if i == 256 else s.l1
        if abs(a) <= l1:
            return 0.0
        return -(a - math.copysign(l1, a)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(400):
        at, y = sorted(rng.sample(range(256), rng.randrange(6))), rng.randrange(2)
        slots = [*at, 256]
        p = 1 / (1 + math.exp(-sum(map(weight, slots))))
        old = {i: weight(i) for i in slots}
        for i in slots:
            g, before = p - y, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / s.alpha * old[i]
            n[i] = before + g * g
        learner.learn(np.array(at, dtype=np.int64), y)
    assert learner.weights(np.arange(257)) == pytest.approx([weight(i) for i in range(257)], abs=1e-9)
    assert 0 < sum(weight(i) == 0 for i in range(256)) < 256


def test_features_against_plain_words():
    texts = ["A b c d a b", "", "x", "b  a\tb"]

    def plain(text):
        words = text.lower().split()
        out = [("w", w) for w in words]
        return {*out, *((gap, a, b) for gap in (1, 2, 3) for a, b in zip(words, words[gap:]))}

    got = toxicity.features(texts, 40)
    assert [len(g) for g in got] == [len(plain(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(plain(a) & plain(b))


# 10


@pytest.mark.parametrize("k", [1, 3])
def test_slopes_against_differences(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        theta, f = np.sort(rng.normal(size=k) * 2), float(rng.normal())
        chances = []
        for y in range(k + 1):
            p, df, d = quality_classifier.slopes(f, theta, y)
            chances.append(p)
            loss = lambda a, t: -math.log(quality_classifier.slopes(a, t, y)[0])  # noqa: B023, E731
            h = 1e-6
            assert df == pytest.approx((loss(f + h, theta) - loss(f - h, theta)) / (2 * h), abs=1e-5, rel=1e-5)
            for i in range(k):
                step = np.eye(k)[i] * h
                assert d[i] == pytest.approx((loss(f, theta + step) - loss(f, theta - step)) / (2 * h), abs=1e-5, rel=1e-5)
        assert sum(chances) == pytest.approx(1)


def test_ratings_may_be_fractions(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "fine"] if i % 2 else ["bad", "poor"]) for _ in range(20)), 2.7 if i % 2 else 2.2) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    model = quality_classifier.fit(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    assert model.grades == (2.2, 2.7)
    mean, tail = model.judge([t for _, t, _ in rows], 2.5)
    assert np.mean([(p >= 0.5) == (q > 2.5) for p, (_, _, q) in zip(tail, rows)]) > 0.98
    assert np.abs(mean - [q for *_, q in rows]).mean() < 0.1


def test_training_rows_are_bounded_in_rows_and_bytes(spark):
    texts = {i: "w" * (1 + i % 7) for i in range(300)} | {300: "x" * 500, 301: "y" * 5000}
    docs = spark.createDataFrame([*texts.items(), (5, "longer text"), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 2000)] + [(4, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    every = training_rows(docs, labels, "toxic", 10**6, 1 << 20, 3).collect()
    ok = {r.i for r in spark.range(302).select("id", held_out(F.col("id")).alias("h")).where("not h").selectExpr("id as i").collect()}
    assert {r.doc_id for r in every} == ok and [r._order for r in every] == sorted(r._order for r in every)
    by = {r.doc_id: r for r in every}
    assert 4 not in ok or by[4].y == 1
    assert 5 not in ok or by[5].text == "longer text"
    few = training_rows(docs, labels, "toxic", 40, 1 << 20, 3).collect()
    assert few == every[:40]
    small = training_rows(docs, labels, "toxic", 10**6, 320, 3).collect()
    within, size = [], 0
    for r in every:
        if len(r.text) <= 20:
            size += len(r.text)
            if size > 320:
                break
            within.append(r)
    assert small == within and len(small) > 10


# 3


def plain_rules(rows, edges, s):
    """The decision list by filtering all rows for each candidate condition."""
    names = list(quality_rules.FEATURES)
    number = lambda value, cut: sum(value > t for t in cut)
    data = [(r["bad"], r["grow"], [number(r[n], e) for n, e in zip(names, edges)]) for r in rows]
    holds = lambda bins, c: bins[c[0]] > c[2] if c[1] else bins[c[0]] <= c[2]
    out = []
    while len(out) < s.most_rules:
        rule, history, left = [], [], data
        while len(rule) < s.most_conditions:
            count = lambda own, grow: (sum(b for b, g, _ in own if g == grow), sum(1 - b for b, g, _ in own if g == grow))
            p0, n0 = count(left, True)
            if not p0 or not n0:
                break
            found = []
            for f, cut in enumerate(edges):
                for b in range(len(cut)):
                    for above in (False, True):
                        p, n = count([x for x in left if holds(x[2], (f, above, b))], True)
                        if p >= s.least_rows:
                            found.append((p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), f, above, b, p, n))
            best = max(found, key=lambda x: (x[0], -x[1], x[2], -x[3]), default=None)
            if best is None or best[0] <= 1e-9:
                break
            alike = sorted((x for x in found if x[1:3] == best[1:3] and x[4:] == best[4:]), key=lambda x: x[3])
            c = alike[len(alike) // 2][1:4]
            rule.append(c)
            left = [x for x in left if holds(x[2], c)]
            history.append((*count(left, True), *count(left, False)))
        if not rule:
            break
        worth = [(q - m) / (q + m) if q + m else (p - n) / (p + n) for p, n, q, m in history]
        keep = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n, q, m = history[keep]
        if p + q < s.precision * (p + q + n + m) or (q + m and q < s.precision * (q + m)):
            break
        out.append([(names[f], above, edges[f][b]) for f, above, b in rule[: keep + 1]])
        data = [x for x in data if not all(holds(x[2], c) for c in rule[: keep + 1])]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rules_against_plain_covering(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        words, symbols, repeats = rng.randrange(50, 300), rng.randrange(40), rng.randrange(30)
        bad = symbols > 25 and words < 180 or repeats > 24
        rows.append((i, int(bad != (rng.random() < 0.03)), words, words * 5, symbols, rng.randrange(4), repeats, 1 + words // 9, rng.randrange(20), rng.randrange(9)))
    frame = spark.createDataFrame(rows, "key long, bad int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long")
    s = quality_rules.Settings(bins=6, most_rules=4, precision=0.8)
    got = quality_rules.learn(frame, s)
    valued = frame.select("bad", (F.pmod(F.xxhash64("key"), F.lit(3)) != 0).alias("grow"), *[F.expr(v).alias(k) for k, v in quality_rules.FEATURES.items()])
    want = plain_rules(valued.collect(), quality_rules.edges_of(valued, s), s)
    assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in got] == want and want


def test_ann_memory_does_not_grow_with_queries():
    """A block of 16,384 vectors, asked by 256 and by 4,096 queries: the same peak but for what comes out."""
    import tracemalloc

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(64, 16))
    m = centres[rng.integers(0, 64, 16_384)] + rng.normal(scale=0.05, size=(16_384, 16))
    index = ann_search.Index(np.arange(len(m)), np.arange(len(m)), m, ann_search.Settings())
    peaks = []
    for n in (256, 4_096):
        tracemalloc.start()
        found, _ = index.search(np.arange(n), m[:n])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == n and all(len(p) == 20 for p, _ in found)
    assert peaks[1] < peaks[0] + 4_096 * 1_500 and peaks[1] < 100 << 20
