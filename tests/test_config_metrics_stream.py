from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry import config as C
from quarry.embed import HashingEmbedder
from quarry.operators import metrics
from quarry.plans.corpus import Corpus
from quarry.streaming import ingest


@pytest.mark.parametrize("name", ["a.json", "b.yaml", "deep/c.yml"])
def test_settings_round_trip(tmp_path, name):
    made = C.Config()
    C.put(made, "chunking.max_tokens", "99")
    C.put(made, "model.endpoint", "http://host:1")
    C.save(made, str(tmp_path / name))
    assert C.load(str(tmp_path / name)) == made and C.get(made, "chunking.max_tokens") == 99


def test_settings_errors(tmp_path):
    assert C.load(str(tmp_path / "none.json")) == C.Config()
    with pytest.raises(ValueError):
        C.load("x.toml")
    (tmp_path / "a.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        C.load(str(tmp_path / "a.json"))
    with pytest.raises(KeyError):
        C.get(C.Config(), "model.none")


def test_histogram(spark):
    rows = spark.createDataFrame([("a", 0.5, True), ("a", 3.0, True), ("a", 99.0, False), ("b", 1.0, True)], "k string, v double, ok boolean")
    got = {(r.k, r.le): r.cumulative for r in metrics.histogram(rows, "v", [1, 5], ["k"]).collect()}
    assert got == {("a", 1.0): 1, ("a", 5.0): 2, ("a", None): 3, ("b", 1.0): 1, ("b", 5.0): 1, ("b", None): 1}
    only = metrics.histogram(rows, "v", [1], only=F.col("ok")).where("le is null").first()
    assert only.total == 3


def test_hit_rate(spark):
    rows = spark.createDataFrame([("x",), ("x",), ("y",), ("x",)], "t string")
    assert tuple(metrics.cache_hit_rate(rows, F.col("t")).first()) == (4, 2, 0.5)
    assert tuple(metrics.cache_hit_rate(rows.limit(0), F.col("t")).first()) == (0, 0, 0.0)


def test_streamed_documents_are_indexed(spark, tmp_path):
    schema = "id string, text string"
    write = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    corpus = Corpus(spark, str(tmp_path / "corpus"), HashingEmbedder(16))
    write(("a", "first text"), ("b", "second text"), ("", "none"))
    for extra in (None, ("a", "third text")):
        if extra:
            write(extra)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest.ingest(stream, corpus, str(tmp_path / "state")).awaitTermination()
    got = {r.id: r.original_text for r in corpus.documents().collect()}
    assert got == {"a": "third text", "b": "second text"}


def test_windows_drop_late_events(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, user_id long, event_type string, value double"
    batches = [[(at, 1, "x", 1.0), (at + dt.timedelta(minutes=5), 1, "x", 2.0)], [(at + dt.timedelta(hours=3), 1, "x", 4.0)], [(at, 1, "x", 100.0)]]
    (tmp_path / "in").mkdir()
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counted = ingest.event_windows(events, "1 hour", late="10 minutes")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = counted.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        run.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = [(r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(2, 3.0)]


def test_sliding_windows_and_sessions(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at, 1, "x", 1.0), (at + dt.timedelta(minutes=20), 1, "x", 2.0), (at + dt.timedelta(hours=2), 1, "x", 3.0)], "ts timestamp, user_id long, event_type string, value double")
    assert ingest.event_windows(rows, "1 hour", "30 minutes").count() == 4
    got = ingest.sessions(rows).orderBy("session_start").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0), (1, 3.0)]
