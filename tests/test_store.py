"""Versioned tables: changes that cost what they change, lookups that open few files, the keyword index, the cache of vectors, files in step."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.embed import EmbeddingCache, HashingEmbedder
from quarry.operators import keyword_index, search
from quarry.plans.corpus import Corpus
from quarry.plans.store import Store, Table

KINDS = {"t": Table({"k": "string", "v": "int"}, "k")}


def rows(store, *args, **kw):
    return sorted((r.k, r.v) for r in store.read("t", *args, **kw).collect())


def put(store, spark, *pairs):
    new = spark.createDataFrame(list(pairs), "k string, v int")

    def change(state, own):
        store.remove("t", state, own, new.select("k"))
        store.append("t", own, new)

    return store.commit(change)


def drop(store, spark, *keys):
    gone = spark.createDataFrame([(k,) for k in keys], "k string")
    return store.commit(lambda state, own: store.remove("t", state, own, gone))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_against_a_dict(spark, tmp_path):
    """Rounds of changes, with compaction and expiry between them, beside a plain dict; old versions stay readable."""
    store, plain, rng, old = Store(spark, str(tmp_path / "s"), KINDS), {}, random.Random(2), {}
    for step in range(7):
        if step % 4 == 3:
            gone = rng.sample(sorted(plain), 3)
            drop(store, spark, *gone, "never there")
            for k in gone:
                del plain[k]
        else:
            new = {f"k{rng.randint(0, 25)}{rng.choice(['', 'ü', ' x', '%_'])}": step for _ in range(8)}
            put(store, spark, *new.items())
            plain |= new
        assert rows(store) == sorted(plain.items())
        old[store.state()["version"]] = dict(plain)
        if step == 5:
            assert store.compact("t", most_parts=1, most_gone=0.0) > 0
            assert rows(store) == sorted(plain.items()) and not any(e.get("gone") for e in store.state()["tables"]["t"].values())
    for version, want in old.items():
        assert rows(store, store.state(version)) == sorted(want.items())
    some = sorted(plain)[:3]
    assert rows(store, None, some) == [(k, plain[k]) for k in some]
    before = store.state()
    assert store.expire(2) > 0 and store.state() == before and rows(store) == sorted(plain.items())
    put(store, spark, ("new", 1))
    assert rows(store) == sorted((plain | {"new": 1}).items())


def test_whole_lists_of_files(spark, tmp_path, monkeypatch):
    """A state read from a whole list and later records is that read from all records."""
    monkeypatch.setattr("quarry.plans.store._EACH_STATE", 2)
    store = Store(spark, str(tmp_path / "s"), KINDS)
    for i in range(5):
        store.commit(lambda state, own, i=i: own.note("n", str(i), i))
    assert (tmp_path / "s" / "versions" / "4.state.json").exists()
    assert store.state()["notes"]["n"] == {str(i): i for i in range(5)} and store.state(3)["notes"]["n"] == {str(i): i for i in range(3)}
    assert store.state(99)["version"] == 0


def test_a_small_change_writes_little(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), KINDS)
    big = spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v"))
    store.commit(lambda state, own: store.append("t", own, big))
    before, files = size(tmp_path), set(store.state()["tables"]["t"])
    put(store, spark, ("k5", -1), ("k77", -1))
    assert size(tmp_path) - before < before / 20
    assert files < set(store.state()["tables"]["t"])
    assert store.read("t").where("v = -1").count() == 2 and store.read("t").count() == 200_000


def test_a_lookup_opens_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarry.plans.store._ONE_FILE", 0)
    store = Store(spark, str(tmp_path / "s"), KINDS)
    rows_ = spark.range(1000).select(F.format_string("k%04d", "id").alias("k"), F.col("id").cast("int").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit(lambda state, own: store.append("t", own, rows_))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    put(store, spark, ("k0300", -1))
    state = store.state()
    assert len(state["tables"]["t"]) == 5  # of each four partitions, and of the change
    assert len(store.entries("t", state, ["k0300"])) == 2 and len(store.entries("t", state, ["k9999", "k0301"])) <= 2
    found = store.read("t", state, ["k0300"])
    assert [tuple(r) for r in found.collect()] == [("k0300", -1)]
    assert len(store.read("t", state, ["k0301"]).inputFiles()) == 1
    many = store.matching("t", state, rows_.where("v < 700").select("k"))
    assert many.count() == 699 + 1 and store.read("t", state, ["none"]).count() == 0


def test_compaction_beside_a_writer(spark, tmp_path):
    """Rows marked as gone while a compaction runs are gone after it."""
    a, b = (Store(spark, str(tmp_path / "s"), KINDS) for _ in range(2))
    for i in range(3):
        put(a, spark, (f"k{i}", i))
    publish, waiting = a._publish, [1]

    def late(version, record):
        if waiting:
            waiting.pop()
            drop(b, spark, "k1")
        return publish(version, record)

    a._publish = late
    assert a.compact("t", most_parts=0) == 3
    assert rows(a) == rows(b) == [("k0", 0), ("k2", 2)] and len(a.state()["tables"]["t"]) == 1


# the keyword index

WORDS = ["the", "There", "theatre", "a", "CompanY", "été", "x-ray", "company's", "1 2", "ab c"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    out = [(f"d{i:03d}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 8)))) for i in range(120)] + [("null", None), ("empty", ""), ("the phrase", "services of the company")]
    return spark.createDataFrame(out, "id string, text string").cache()


@pytest.mark.parametrize("query", ["the", "t", "he", "the company", "The COMPANY of", "été the zzz", "zzz", "   ", "the the there", "a b c d e f g h i j k l", "services of the company", "1 2", "thea"])
def test_index_answers_as_the_scan(spark, texts, query):
    words = keyword_index.words_of(texts)
    grams = keyword_index.grams_of(words)
    got = keyword_index.search(
        spark, query, 20,
        lambda asked: grams.where(F.col("gram").isin(asked)),
        lambda some: words.join(some, "word", "left_semi"),
        lambda ids: texts.withColumnRenamed("id", "document_id").join(ids, "document_id", "left_semi"),
    ).collect()
    want = search.keyword_search(texts, query, 20, id_="id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_index_follows_changes(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16))
    scan = lambda q: [tuple(r) for r in search.keyword_search(c.table("documents"), q, 10, "original_text", "id").collect()]
    same = lambda q: [tuple(r) for r in c.search_words(q).collect()] == scan(q)
    c.index(spark.createDataFrame([("a", "red apples"), ("b", "green apples and pears"), ("c", "blue whales")], "id string, text string"))
    assert same("apples") and same("apples and pears")
    c.index(spark.createDataFrame([("a", "red cherries"), ("d", "green apples")], "id string, text string"))
    assert same("apples") and same("red") and scan("apples")[0][0] == "b"
    c.delete("b")
    assert same("apples") and same("pears") and scan("pears") == []
    c.compact(most_parts=0)
    assert same("apples") and same("green apples") and c.table("postings").where("n <> 1").count() == 0
    opened, every = c.reads("documents", "a")
    assert opened == every == 1
    assert c.search("Which company sells cherries?").first() is not None


# the cache of vectors


class Counting(HashingEmbedder):
    """Notes in files which texts were embedded."""

    def __init__(self, at):
        super().__init__(8)
        self.at = str(at)

    def column(self, text):
        at = self.at

        @F.udf("string")
        def noted(t):
            with open(os.path.join(at, "log"), "a") as f:
                f.write(repr(t) + "\n")
            return t

        return super().column(noted(text))

    def seen(self):
        at = os.path.join(self.at, "log")
        lines = open(at).read().splitlines() if os.path.exists(at) else []
        if lines:
            os.unlink(at)
        return sorted(lines)


def test_cache(spark, tmp_path):
    e, cache = Counting(tmp_path), EmbeddingCache(spark, str(tmp_path / "cache"))
    ask = lambda *t: {r.text: r.embedding for r in cache.embed(spark.createDataFrame([(x,) for x in t], "text string"), e).collect()}
    first = ask("one", "two", "two", None, "")
    assert e.seen() == ["'one'", "'two'"] and first[None] is None and first[""] is None
    assert first["one"] == pytest.approx(e.query("one"))
    again = ask("two", "three")
    assert e.seen() == ["'three'"] and again["two"] == first["two"]
    assert ask("one", "two", "three") and e.seen() == []
    kept = cache.stats()
    assert (kept["requests"], kept["hits"], kept["vectors"], kept["bytes"]) == (8, 5, 3, 3 * 96)
    other = HashingEmbedder(4)
    assert len(cache.embed(spark.createDataFrame([("one",)], "text string"), other).first().embedding) == 4
    assert cache.evict(10**6) == 0 and cache.stats()["vectors"] == 4
    assert cache.evict(200) == 2  # the last run's vector stays, and one of the run before fits beside it
    ask("one", "two", "three")
    assert len(e.seen()) == 2


def test_a_second_index_embeds_nothing(spark, tmp_path):
    e = Counting(tmp_path)
    c = Corpus(spark, str(tmp_path / "c"), e, cache=EmbeddingCache(spark, str(tmp_path / "cache")))
    docs = spark.createDataFrame([("a", "red apples"), ("b", "green pears")], "id string, text string")
    c.index(docs)
    assert len(e.seen()) == 2
    c.index(docs.unionByName(spark.createDataFrame([("c", "red apples")], "id string, text string")))
    assert e.seen() == [] and c.table("embeddings").count() == 3


# files in step


def test_files_in_step(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for name, text in (("a.txt", "some notes"), ("b.txt", "more notes"), ("c.csv", "k,v\na,1\n")):
        (at / name).write_text(text)
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16))
    first = c.sync_files(str(at))
    assert (first["indexed"], first["unchanged"], first["retired"]) == (3, 0, 0)
    files = {p for p in (tmp_path / "c").rglob("*.parquet")}
    again = c.sync_files(str(at))
    assert (again["version"], again["indexed"], again["unchanged"]) == (first["version"], 0, 3)
    assert files == {p for p in (tmp_path / "c").rglob("*.parquet") if "p0-" not in str(p)} | files
    os.utime(at / "a.txt", (1, 1))  # another time, the same content
    assert (c.sync_files(str(at))["indexed"], c.document("a")["original_text"]) == (0, "some notes")
    (at / "b.txt").write_text("other notes")
    (at / "c.csv").unlink()
    last = c.sync_files(str(at))
    assert (last["indexed"], last["unchanged"], last["retired"]) == (1, 1, 1)
    assert {r.id: r.original_text for r in c.documents().collect()} == {"a": "some notes", "b": "other notes"}
    assert c.table("files").count() == 2
    (at / "a.md").write_text("takes the id of another")
    got = c.sync_files(str(at))
    assert (got["indexed"], got["failed"]) == (1, 0) or "a.md" in got["errors"][0]["path"] or got["errors"] == []


def test_batches_count_once(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16))
    docs = lambda t: spark.createDataFrame([("a", t)], "id string, text string")
    assert c.index(docs("one"), batch=("q", 0)) == 1
    assert c.index(docs("two"), batch=("q", 0)) == 1 and c.document("a")["original_text"] == "one"
    assert c.index(docs("two"), batch=("q", 1)) == 2 and c.index(docs("three"), batch=("other", 0)) == 3
    assert c.document("a")["original_text"] == "three"


def test_pages_of_the_listing(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16))
    c.index(spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(5)], "id string, text string"))
    c.index(spark.createDataFrame([("e", "later"), ("d3", "again")], "id string, text string"))
    seen, after = [], None
    while True:
        rows_, after = c.page(2, after)
        seen += [r["id"] for r in rows_]
        if after is None:
            break
    assert seen == [r.id for r in c.documents().collect()] and seen[:2] == ["d3", "e"] and "original_text" not in rows_[0]


def test_content_files(spark, tmp_path):
    from quarry.functions import text as T
    from quarry.operators import catalog

    texts = {"a": "one\ntwo", "b c": "é \r\n x", "d": ""}
    docs = spark.createDataFrame(list(texts.items()), "id string, original_text string").withColumn("content_hash", T.content_hash(F.col("original_text")))
    made = catalog.write_content_files(docs, str(tmp_path / "out")).collect()
    assert {r.file_path.rsplit("/", 1)[1] for r in made} == {f"file_name={r.id}_{r.content_hash[:8]}.txt.gz" for r in docs.collect()}
    read = spark.read.option("lineSep", "\x00").text(str(tmp_path / "out")).collect()
    assert {(r.file_name.split("_")[0], r.value) for r in read} == set(texts.items())


def test_source_path(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16), keywords=False)
    c.index(spark.createDataFrame([("a", "one company"), ("b", "two")], "id string, text string"))
    c.update_source_path("a", "/new/place")
    assert {r.id: r.source_path for r in c.documents().collect()} == {"a": "/new/place", "b": None}
    with pytest.raises(KeyError):
        c.update_source_path("none", "x")
    assert "postings" not in c.manifest()["tables"] and c.search_words("company").first().document_id == "a"
    assert {r.operation for r in c.metrics().collect()} == {"index"}
