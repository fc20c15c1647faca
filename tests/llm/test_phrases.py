"""Collocations beside plain counting, with odd rows, both kinds of dictionary, and keys wider than 64 bits."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import phrases
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import both, database

SCHEMA = "doc_id long, text string, lang string, f long, id long, word string, i1 string, phrase string, _row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, covered, top):
    runs: dict[str, list[list[str]]] = {}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            runs.setdefault(lang or "und", []).append([w for w in re.split(r"[ \t]+", piece) if w])
    out = []
    for lang, pieces in runs.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
        good = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside: Counter = Counter()
        for g, a in good.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], a)
        found = []
        for g, a in good.items():
            if 100 * inside[g] >= covered * a and inside[g]:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(a for g, a in f.items() if len(g) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["Alpha", "beta", "gam\x01ma", "gam", "Δelta", "épsi", "zeta x", "eta\x1c"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("...", "de"), ("one", None)]
    for lang in ("en", "de", None):
        for _ in range(60):
            text = ""
            for _ in range(rng.randint(1, 60)):
                text += rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", ". ", "  ", ";"])
            rows.append((text, lang))
    rows += [("new york city hall", "en")] * 40 + [("in new york", "und")] * 7
    rows.append((" ".join(rng.choice(words) for _ in range(60_000)), "de"))
    return rows


@pytest.mark.parametrize("sent,each,least,top", [(10**6, 10**6, 5, 2000), (10**6, 3_000, 30, 7), (0, 5_000, 5, 2000)])
def test_against_plain_counting(spark, sent, each, least, top):
    rows = corpus()
    df = spark.createDataFrame([(i, t, lang, 1, 2, "w", "x", "p", "r") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.mine(df, phrases.Settings(least=least, top=top, sent_words=sent, range_keys=each)).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, least, 80, top)


def test_against_sql(spark, small):
    got, want = both(database(small), QUERIES["op11_phrases"](spark, small), ORACLE_SQL["op11_phrases"])
    assert got == want and got


def test_empty(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, None, None, 1, 2, None, None, None, None)], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [1, 5, 16, 17, 21, 27, 31, 32])
def test_keys_keep_ids_and_order(width):
    rng = np.random.default_rng(width)
    ids = [rng.integers(0, 1 << width, 500) for _ in range(4)]
    hi, lo = phrases.pack(ids, width)
    assert all((a == b).all() for a, b in zip(phrases.unpack(hi, lo, width), ids))
    order = phrases.radix_order(hi, lo, 4 * width)
    assert list(zip(*(x[order] for x in ids))) == sorted(zip(*ids))
    h, x, n = phrases.counted_runs(hi, lo, None, 4 * width)
    assert dict(zip(zip(h.tolist(), x.tolist()), n.tolist())) == Counter(zip(hi.tolist(), lo.tolist()))
    assert all((a == b).all() for a, b in zip(phrases._from_block(phrases._to_block(h, x, n)), (h, x, n)))


def test_products_beyond_64_bits(spark):
    """The score of counts whose product with two million passes 64 bits."""
    a, total = 9 * 10**15, 19 * 10**15
    row = spark.createDataFrame([(a, total - 7, 7)], "a long, l long, r long")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    assert row.select(score.alias("s")).first().s == 2_000_000 * a // total
