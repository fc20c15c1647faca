from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.session import stage
from tests.llm.test_jaccard_dedup import heads
from tests.llm.test_operators import check_pieces


@pytest.fixture(scope="module")
def staged(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "src1", 0), (10**6 + 1, None, "xx", None, 1)], docs.schema)
    out = [docs.unionByName(odd).withColumns({"_score": F.lit(1), "domain": F.lit("x"), "_head": F.lit(2)})]
    for name, f in P.STAGES:
        out.append(stage(f(spark, out[-1], small), name))
    return out


def test_stages_return_the_columns_and_shrink(staged):
    sizes = [d.count() for d in staged[:-1]]
    assert all(tuple(d.columns) == P.COLUMNS for d in staged[1:-1]) and sizes == sorted(sizes, reverse=True)
    for a, b in zip(staged, staged[1:-1]):
        assert b.select("doc_id").exceptAll(a.select("doc_id")).count() == 0


def test_labels_take_effect(spark, small, staged):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    share = lambda before, after, bad: (before.join(labels, "doc_id").where(bad).count(), after.join(labels, "doc_id").where(bad).count())
    low, left = share(staged[0], staged[1], "quality = 0")
    assert left <= 0.3 * low
    good, kept = share(staged[0], staged[1], "quality = 1")
    assert kept >= 0.97 * good
    clean, kept = share(staged[1], staged[2], "toxic = 0")
    assert kept >= 0.98 * clean


def test_one_of_each_group_stays(staged):
    rows = [(r.doc_id, r.text) for r in staged[2].select("doc_id", "text").collect() if r.doc_id is not None]
    kept = [r.doc_id for r in staged[3].collect() if r.doc_id is not None]
    assert sorted(kept) == sorted(heads(rows))


def test_packing_holds_every_token(staged):
    check_pieces(staged[5].collect(), {r.doc_id: r.text for r in staged[4].collect()})


def test_run(spark, small):
    assert P.run(spark, small).count() > 0 and P.ORACLE_SQL is None
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "toxicity", "simhash_dedup", "mixing", "packing"]
