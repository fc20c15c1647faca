"""What a corpus stores is computed once, in as many files as its size asks for, and compacted only where that is asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalogue import QUERIES
from quarry.embed import HashingEmbedder
from quarry.functions import text as T
from quarry.operators import catalog
from quarry.plans.corpus import Corpus
from quarry.plans.store import Store, Table

KINDS = {"t": Table({"k": "string", "v": "int"}, "k")}


def counting(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(passed, rows.schema), seen


def test_rows_are_computed_once_and_dealt_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarry.plans.store._ONE_FILE", 0)
    store = Store(spark, str(tmp_path / "s"), KINDS)
    rows, seen = counting(spark, spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v")))
    store.commit(lambda state, own: store.append("t", own, rows))
    assert seen.value == 1000
    spans = sorted((e["lo"], e["hi"]) for e in store.state()["tables"]["t"].values())
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert store.read("t", None, ["k7", "k999", "none"]).count() == 2 and store.read("t").count() == 1000


def test_files_are_bounded_where_the_planner_is_wrong(spark, tmp_path, monkeypatch):
    """It takes a join for the product of its sides, which would be millions of files."""
    monkeypatch.setattr("quarry.plans.store.size_of", lambda df: 1 << 60)
    rows = spark.range(10).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v"))
    entries = Store(spark, str(tmp_path / "s"), KINDS).write("t", rows)
    assert sum(e["rows"] for e in entries.values()) == 10 and len(entries) <= 16


def test_texts_of_a_corpus_are_read_once(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(8))
    words = " ".join(f"w{i}" for i in range(700))
    docs, seen = counting(spark, spark.createDataFrame([("a", words), ("b", " b\x0bc d "), ("d", "e")], "id string, text string"))
    c.index(docs)
    assert seen.value == 2 * 3  # to find repeated ids, and to split
    rows = {r.id: r for r in c.table("documents").collect()}
    assert rows["a"].original_text == words and rows["a"].chunk_count == c.chunks("a").count() > 1 and rows["b"].chunk_count == 1
    assert c.table("embeddings").count() == c.table("chunks").count()
    told = {r["name"]: r.value for r in c.metrics().collect()}
    assert told["documents"] == 3 and told["tokens"] == 700 + 2 + 1 and told["chunks"] == c.table("chunks").count()


def test_fast_forms_of_white_space(spark):
    odd = [(f"{a}x{b}{a} {b}y{c}",) for a in [*T.SPACES, "\x1c", "​", "\n\r ", "  "] for b in ("", " ", "　\t", "\x0b") for c in ("", "  ", "\x0c\n")]
    t, o = F.col("t"), spark.createDataFrame(odd, "t string")
    plain = F.regexp_replace(t, F.lit(f"^[{T.SPACE}]+|[{T.SPACE}]+\\z"), F.lit(""))
    same = (T.trim(t) == plain) & (T.collapse(t) == F.regexp_replace(t, F.lit(f"[{T.GAP}]+"), F.lit(" "))) & (F.split(t, T.SPACE_RUN) == F.split(t, f"[{T.SPACE}]+"))
    assert o.where(~same).count() == 0


def test_only_what_asks_for_compaction_gets_it(spark, small):
    made = spark.sparkContext.__dict__.setdefault("_quarry_made", {})
    for kind in ("corpus", "compacted"):
        made.pop((kind, small), None)
    assert QUERIES["stored_changes"](spark, small).count() > 0
    corpus, before = made["corpus", small]
    assert corpus.manifest()["version"] == before == 3
    assert QUERIES["stored_compacted"](spark, small).count() == QUERIES["stored_changes"](spark, small).count()
    assert corpus.manifest()["version"] > before and not any(e.get("gone") for e in corpus.manifest()["tables"]["documents"].values())


def test_all_chunks_are_joined(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(8), max_tokens=40, overlap=8)
    sentence = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = {
        "one": "a  single\tchunk. ",
        "many": "\n ".join(sentence(k, 6 + k % 5) + ".!?"[k % 3] for k in range(30)) + "\n",
        "same": "is it. " * 90,
        "windows": sentence(1, 300),
        "after": " ".join(sentence(k, 7) + "." for k in range(20)) + " what follows",
    }
    c.index(spark.createDataFrame(list(texts.items()), "id string, text string"))
    docs, chunks = c.table("documents"), c.table("chunks")
    joined = lambda some: {r.document_id: r.text for r in catalog.joined_chunks(docs, some).collect()}
    assert chunks.where("chunk_index = 3").count() == 4 and joined(chunks) == texts
    assert set(joined(chunks.where("not (document_id = 'many' and chunk_index = 2)"))) == set(texts) - {"many"}
    other = F.when((F.col("document_id") == "many") & (F.col("chunk_index") == 2), F.replace("chunk_text", F.lit("w"), F.lit("v"))).otherwise(F.col("chunk_text"))
    assert set(joined(chunks.withColumn("chunk_text", other))) == set(texts) - {"many"}


def test_the_query_joins_more_than_the_first_chunk(spark, small, monkeypatch):
    own = Corpus.chunks
    assert QUERIES["stored_chunks"](spark, small).count() == 1
    monkeypatch.setattr(Corpus, "chunks", lambda self, id_: own(self, id_).where("chunk_index <> 1"))
    assert QUERIES["stored_chunks"](spark, small).count() == 0
