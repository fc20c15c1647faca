"""Ranked lexical search beside scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import ranked_search
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import both, database

DOCS = "doc_id long, text string, row long, n long, tid long, term string, item_id string"
ITEMS = "item_id long, text string, term string, doc_id long, row long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, top):
    held = [(d, Counter(terms(t))) for d, t in docs]
    whole, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in asked.items():
        scored = []
        for d, c in held:
            m = 50 + (50 * c.total() * whole) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in ws if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "of", "and", "in", "é", "ß2", "Straße"] + [f"w{i}" for i in range(60)]
    weights = [60, 50, 40, 30, 8, 8, 3] + [20 / (i + 1) for i in range(60)]
    some = lambda n: "".join(w + rng.choice([" ", ", ", "-", "\n", "\x7f"]) for w in rng.choices(words, weights, k=n))
    docs = [(i, some(rng.choice([1, 5, 30, 30, 120]))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(90)]  # ties
    docs += [(7, docs[3][1]), (None, docs[9][1]), (900, None), (901, ""), (902, " .,;"), (903, some(30_000))]
    items = [(i, some(rng.choice([1, 3, 12, 40]))) for i in range(25)] + [(30, None), (31, "..."), (32, "nowhere atall"), (5, "w50 w51"), (33, docs[7][1]), (34, "the")]
    return docs, items


@pytest.mark.parametrize("seed,top,block", [(1, 50, 10**6), (2, 3, 10**6), (3, 1, 60), (4, 1000, 10**6)])
def test_against_every_score(spark, seed, top, block):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, 1, 2, 3, "x", "y") for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], ITEMS)
    got = ranked_search.search(d, q, ranked_search.Settings(top, block))
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items, top)


def test_against_sql(spark, small):
    got, want = both(database(small), QUERIES["op13_ranked_search"](spark, small), ORACLE_SQL["op13_ranked_search"])
    assert got == want and got


def test_empty(spark):
    d, q = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one_d, one_q = spark.createDataFrame([(1, "a b", 1, 2, 3, "x", "y")], DOCS), spark.createDataFrame([(1, "a", "x", 1, 2)], ITEMS)
    assert ranked_search.search(d, one_q).count() == 0
    assert ranked_search.search(one_d, q).count() == 0
    assert [tuple(r) for r in ranked_search.search(one_d, one_q).collect()] == plain([(1, "a b")], [(1, "a")], 50)


def test_prunes(spark):
    """Few documents are looked up where a few stand out."""
    rng = random.Random(9)
    docs = [(i, " ".join(["common", "usual", f"r{rng.randint(0, 400)}"] + ["x"] * rng.randint(0, 30))) for i in range(3000)] + [(5000 + i, "rare word common") for i in range(5)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "rare word common usual")], "item_id long, text string")
    looked = []
    own = ranked_search.stage

    def counting(df, name="t", rows=None):
        out = own(df, name, rows)
        if name == "candidates":
            looked.append(out.count())
        return out

    ranked_search.stage = counting
    try:
        got = ranked_search.search(d, q, ranked_search.Settings(5)).collect()
    finally:
        ranked_search.stage = own
    assert sorted(r.doc_id for r in got) == [5000, 5001, 5002, 5003, 5004] and looked[0] < 50


def test_many_rows_in_small_files_are_not_broadcast(spark):
    """Copies of a text are candidates of every item that it answers: millions of rows, which take a few MB as files."""
    from quarry.session import limited, stage

    few, many = (stage(spark.range(n).select((F.col("id") % 7).alias("item"), F.col("id").alias("row")), "candidates") for n in (10, 1000))
    lists = stage(spark.range(3000).select(F.col("id").alias("row"), F.lit(1).alias("impact")), "lists")
    for how in ("inner", "left_semi", "left_anti", "left"):
        plan = lambda t: lists.join(limited(t, 500), "row", how)._jdf.queryExecution().executedPlan().toString()  # noqa: B023, E731
        assert "BroadcastHashJoin" in plan(few)
        assert "Broadcast" not in plan(many) and "SortMergeJoin" in plan(many)
    assert lists.join(limited(many, 500), "row").count() == 1000
