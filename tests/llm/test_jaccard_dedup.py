"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from quarry.llm import jaccard_dedup, simhash_dedup


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def heads(rows, least=0.8):
    """The smallest id of each component of ``rows`` ``(doc_id, text)``, by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                parent[root(i)] = root(j)
    out = {}
    for i, (k, _) in enumerate(rows):
        out[root(i)] = min(k, out.get(root(i), k))
    return set(out.values())


def planted():
    """Near copies of every closeness, a passage that many texts share, and a group of copies of one text."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]

    def edited(base, edits):
        out = list(base)
        for _ in range(edits):
            out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
        return out

    texts = []
    for n in (1, 4, 5, 6, 9, 12, 40, 90, 200):
        base = words(n)
        texts += [base, *(edited(base, e) for e in (1, 1, 2, 3, 4, 6)), base[: max(1, n * 5 // 6)], base + words(n // 8)]
    passage = words(30)
    texts += [words(10) + passage + words(10) for _ in range(60)]
    base = words(120)
    texts += [edited(base, rng.randrange(5)) for _ in range(60)]
    out = [" ".join(t) for t in texts] + ["", " ", None, "A b c d E f g", "a B c d e F g"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("crowd", [2, 32])
def test_stage_keeps_one_of_each_group_of_near_copies(spark, crowd):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_dedup.components(frame, crowd=crowd).collect()
    least = {}
    for r in found:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert len(found) == len(rows) and sorted(least.values()) == sorted(heads(rows))


def test_recurring_hashes_change_the_work_and_not_the_result(spark, monkeypatch):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(jaccard_dedup.recurring(frame.select("text"), 5)) > 20
    for most in (0, 7):
        monkeypatch.setattr(jaccard_dedup.recurring, "__defaults__", (most,))
        kept = simhash_dedup.representatives(frame, 5, 0.8).collect()
        assert sorted(r.doc_id for r in kept) == sorted(heads(rows))


def test_rows_that_share_an_id_stand_for_their_own_components(spark):
    one, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, other), (2, one + " end"), (3, other), (None, other), (1, one), (None, "alone"), (None, "alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "2 as key", "3 as fp")
    for kept in (simhash_dedup.representatives(frame, 5, 0.8), simhash_dedup.representatives(frame.where("text not like '% end'"))):
        assert kept.columns == frame.columns
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", one), ("1", other), ("None", "alone")])


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark, small):
    base = [f"w{i}" for i in range(200)]
    near = base[:50] + ["other"] + base[51:100] + ["word"] + base[101:]
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, " ".join(base[::-1]), "en", "s", 1), (None, " ".join(near), "en", "s", 1)]
    kept = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), small)
    assert tuple(kept.columns) == P.COLUMNS and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_tables_without_rows_or_ids(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f")], "doc_id long, text string")
    assert simhash_dedup.representatives(frame, 5, 0.8).count() == 1
    assert simhash_dedup.representatives(frame.limit(0), 5, 0.8).count() == 0


def test_links_by_fingerprints_count_too(spark):
    """Texts that repeat one passage have one fingerprint, though most of their distinct shingles are their own."""
    passage = " ".join(f"p{i}" for i in range(21)) + " "
    rows = [(k, passage * 60 + " ".join(f"{c}{i}" for i in range(25))) for k, c in enumerate("abc", 1)] + [(4, " ".join(f"d{i}" for i in range(40)))]
    assert heads(rows) == {1, 2, 3, 4}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.fp for r in simhash_dedup.components(frame).where("doc_id < 4").collect()}) == 1
    assert sorted(r.doc_id for r in simhash_dedup.representatives(frame, 5, 0.8).collect()) == [1, 4]
