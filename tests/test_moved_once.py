"""Texts are processed and moved once, and the keyword index holds each word once."""

from __future__ import annotations

from quarry.embed import EmbeddingCache, HashingEmbedder, embed_chunks
from quarry.plans.corpus import Corpus, _smallest


def test_texts_are_processed_once(spark):
    chunks = spark.createDataFrame([("a", "d", "one  two"), ("b", "d", "one two"), ("c", "d", " ")], "chunk_id string, document_id string, chunk_text string")
    made = embed_chunks(chunks, HashingEmbedder(8))
    assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.chunk_id: r.embedding for r in made.collect()}
    assert set(got) == {"a", "b"} and got["a"] == got["b"]


def test_texts_asked_of_the_cache_are_digests(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "c"))
    texts = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "text string")
    for hits in (0, 2):
        assert cache.embed(texts, HashingEmbedder(8)).where("embedding is not null").count() == 3
        asked = [p for p in spark.sparkContext._quarry_staged if "stage-asked-" in p][-1]
        assert sorted(spark.read.parquet(asked).columns) == ["digest", "requests"]
        assert cache.requests().where("hit").count() == hits


def test_words_are_kept_once(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "k"), HashingEmbedder(8))
    docs = spark.createDataFrame([("a", "green apples"), ("b", "apples and pears")], "id string, text string")
    assert _smallest(docs) is docs
    c.index(docs)
    c.index(spark.createDataFrame([("b", "pears"), ("b", "plums"), ("d", "apples")], "id string, text string"))
    c.compact(most_parts=1)
    assert sorted(r.word for r in c.table("words").collect()) == ["and", "apples", "green", "pears"]
    assert sorted(r.document_id for r in c.search_words("pple").collect()) == ["a", "d"]
    assert [r.document_id for r in c.search_words("pears").collect()] == ["b"]
    assert "grams" not in c.manifest()["tables"]
