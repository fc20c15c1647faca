from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.embed import HashingEmbedder, HttpEmbedder, KeywordEmbedder, embed_chunks
from quarry.operators import catalog, search
from quarry.plans import chat
from quarry.plans.corpus import Corpus


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, text string")


@pytest.fixture
def corpus(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "corpus"), HashingEmbedder(32), 40, 5)
    c.index(docs(spark, ("doc1", "red apples and green pears"), ("doc10", "blue whales in the sea"), ("doc_1", "the company sells red paint")))
    return c


def test_index_search_and_index_again(spark, corpus):
    top = corpus.search("red apples").first()
    assert top.id == "doc1" and top.score > 0.5 and top.metadata.chunk_index == 0
    first = corpus.document("doc1")
    long = ". ".join(f"chapter {i} of the apple book" for i in range(30)) + "."
    corpus.index(docs(spark, ("doc1", long)))
    again = corpus.document("doc1")
    assert again["created_at"] == first["created_at"] and again["updated_at"] > first["updated_at"]
    assert corpus.chunks("doc1").count() == again["chunk_count"] > 1
    assert corpus.health() == {"status": "ok", "version": 2, "documents": 3}


def test_delete_takes_the_exact_id(corpus):
    corpus.delete("doc1")
    assert {r.id for r in corpus.documents().collect()} == {"doc10", "doc_1"}
    assert {r.document_id for r in corpus.table("embeddings").collect()} == {"doc10", "doc_1"}
    with pytest.raises(KeyError):
        corpus.delete("doc1")


def test_update_chunk(corpus):
    corpus.update_chunk("doc10", "purple trains on rails")
    got = corpus.chunk("doc10")
    assert got["chunk_text"] == "purple trains on rails" and got["token_count"] == 4
    assert corpus.search("purple trains").first().id == "doc10"
    with pytest.raises(KeyError):
        corpus.update_chunk("none", "x")


def test_keyword_hits_come_after_vector_hits(corpus):
    rows = corpus.search("company", 1).collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].fallback_search is False


def test_bad_input(spark, corpus):
    with pytest.raises(ValueError):
        corpus.search("")
    with pytest.raises(ValueError):
        corpus.index(docs(spark, ("x", "")))
    with pytest.raises(ValueError):
        Corpus(spark, "/tmp/none", max_tokens=5, overlap=5)
    with pytest.raises(ValueError):
        corpus.reset()


def test_a_failed_change_leaves_the_version(spark, corpus):
    before = corpus.manifest()
    broken = lambda state, change: corpus.store.append("documents", change, corpus.table("documents", state).withColumn("doc_type", F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        corpus.store.commit(broken)
    assert corpus.manifest() == before and corpus.documents().count() == 3


def test_writers_do_not_lose_each_others_changes(spark, tmp_path):
    a, b = (Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16)) for _ in range(2))
    a.index(docs(spark, ("zero", "to begin with")))
    publish, waiting = a.store._publish, [("second", "of the other writer")]

    def late(version, record):
        if waiting:  # another writer is done between this one's reading and its publishing
            b.index(docs(spark, waiting.pop()))
        return publish(version, record)

    a.store._publish = late
    a.index(docs(spark, ("first", "of this writer")))
    assert {r.id for r in b.documents().collect()} == {"zero", "first", "second"} and a.manifest()["version"] == 3
    assert {r.document_id for r in b.table("embeddings").collect()} == {"zero", "first", "second"}


def test_writers_in_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16)).index(docs(spark, ("x", "to begin with")))
    put = lambda i: Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16)).index(docs(spark, (f"d{i}", f"text {i}")))
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(put, range(3)))
    assert sorted(versions) == [2, 3, 4]
    assert {r.id for r in Corpus(spark, str(tmp_path / "c")).documents().collect()} == {"x", "d0", "d1", "d2"}


def test_a_change_adds_files_and_old_versions_go(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16))
    c.index(docs(spark, *[(f"d{i}", f"text {i}") for i in range(40)]))
    before = c.manifest()["tables"]["chunks"]
    c.index(docs(spark, ("d7", "another text")))
    after = c.manifest()["tables"]["chunks"]
    assert set(before) < set(after) and len(after) == len(before) + 1 and sum("gone" in e for e in after.values()) == 1
    c.delete("d7", "d8")
    assert c.documents().count() == 38 and c.expire(1) == 2 and c.expire(1) == 0
    assert c.documents().count() == 38 and c.table("chunks").count() == 38
    used = {p.split("/")[0] for t in c.manifest()["tables"].values() for f, e in t.items() for p in (f, *(g for g, _ in e.get("gone", [])))}
    assert {p.name for p in (tmp_path / "c").iterdir()} == used | {"versions", "metrics"}


def test_files_that_fail_are_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("some notes")
    (tmp_path / "in" / "a.csv").write_text("k,v\na,1\n")
    (tmp_path / "in" / "broken.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "in" / "empty.txt").write_text(" \n")
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16))
    got = c.index_files(str(tmp_path / "in"))
    assert (got["indexed"], got["failed"]) == (1, 3) and c.document("a")["doc_type"] == "csv"
    assert [e["path"].rsplit("/", 1)[1] for e in got["errors"]] == ["a.txt", "broken.xlsx", "empty.txt"]
    assert "a.csv" in got["errors"][0]["error"] and got["errors"][2]["error"] == "no text"
    assert c.index_files(str(tmp_path / "in" / "empty.txt"))["version"] == got["version"]


def test_index_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "notes.txt").write_text("some notes on boats")
    (tmp_path / "in" / "table.csv").write_text("k,v\na,1\n")
    c = Corpus(spark, str(tmp_path / "c"), HashingEmbedder(16))
    c.index_files(str(tmp_path / "in"))
    assert {(r.id, r.doc_type, r.chunk_count) for r in c.documents().collect()} == {("notes", "txt", 1), ("table", "csv", 2)}
    c.reset(force=True)
    assert c.documents().count() == 0


class Echo:
    def __init__(self, reply):
        self.reply, self.seen = reply, []

    def complete(self, system, message, temperature):
        self.seen.append((system, temperature))
        return "red apples" if system == chat.REWRITE else self.reply


def test_chat(corpus):
    model = Echo("Apples are red [doc1], it is said [nowhere].")
    got = corpus.chat("What colour are apples?", model, 2)
    assert got["query"] == "red apples" and got["cited"] == ["doc1"]
    assert got["sources"][0]["id"] == "doc1" and "[doc1], relevance" in model.seen[1][0]


def test_search_batch_equals_single_searches(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 10").alias("document_id"), "embedding")
    asked = vectors.where("chunk_id in (3, 77)").select(F.col("chunk_id").alias("query_id"), "embedding")
    many = search.search_batch(vectors, asked, 7, block=100, query_block=1).collect()
    for q in asked.collect():
        one = [(r.document_id, r.chunk_id) for r in search.search_vectors(vectors, list(q.embedding), 7).collect()]
        assert [(r.document_id, r.chunk_id) for r in sorted(many, key=lambda r: r.rank) if r.query_id == q.query_id] == one


def test_odd_vectors(spark):
    rows = spark.createDataFrame([("a", "1", [1.0, 0.0]), ("b", "2", None), ("c", "3", [0.0, 0.0]), ("d", "4", [1.0]), ("e", "5", [1.0, 1.0]), ("f", "6", [1.0, 0.0])], "chunk_id string, document_id string, embedding array<float>")
    got = search.top_chunks(rows, [2.0, 0.0], 10).collect()
    assert [(r.chunk_id, round(r.score, 4)) for r in got] == [("a", 1.0), ("f", 1.0), ("e", 0.7071)]
    with pytest.raises(ValueError):
        search.top_chunks(rows, [])


@pytest.mark.parametrize("asked, most, want", [(0, None, 10), (-3, None, 10), (None, None, 10), (7, None, 7), (99, 50, 50)])
def test_limits(asked, most, want):
    assert search.limit_of(asked, most) == want


def test_upsert_and_unmatched(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in catalog.upsert(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    a = spark.createDataFrame([("x",), ("y",)], "chunk_id string")
    b = spark.createDataFrame([("y",), ("z",)], "chunk_id string")
    assert {tuple(r) for r in catalog.unmatched(a, b).collect()} == {("x", "no vector"), ("z", "no chunk")}


def test_local_embedders_agree_on_driver_and_executors(spark):
    texts = ["", "Test the file content", "AI and machine learning integration " * 9, "ünï code ünï"]
    for e in (HashingEmbedder(16), KeywordEmbedder()):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", e.column(F.col("t")).alias("v")).collect()
        for r in rows:
            assert list(r.v) == pytest.approx(e.query(r.t), abs=1e-6)


class Server(BaseHTTPRequestHandler):
    fails = 0
    calls = 0

    def do_POST(self):
        Server.calls += 1
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
        if Server.fails:
            Server.fails -= 1
            self.send_error(500)
            return
        body = json.dumps({"embedding": [] if prompt == "nothing" else [float(len(prompt)), 1.0]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Server.calls = Server.fails = 0
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_embedder(spark, server):
    e = HttpEmbedder(server, retries=2)
    Server.fails = 2
    assert e.embed("abc") == [3.0, 1.0] and Server.calls == 3
    Server.fails = 9
    with pytest.raises(RuntimeError):
        e.embed("abc")
    Server.fails = 0
    with pytest.raises(RuntimeError):
        e.embed("nothing")
    with pytest.raises(ValueError):
        e.embed("")
    Server.calls = 0
    chunks = spark.createDataFrame([(str(i), "d", "same text") for i in range(20)], "chunk_id string, document_id string, chunk_text string")
    got = embed_chunks(chunks, e).collect()
    assert len(got) == 20 and {tuple(r.embedding) for r in got} == {(9.0, 1.0)} and Server.calls == 1
