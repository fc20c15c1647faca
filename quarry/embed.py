"""Embedders: local deterministic ones inside the JVM, and a client for a model server."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.store import Store, Table
from quarry.session import limited, ship, small_batches, stage


_WORD = re.compile(T.TOKEN)
_WORD_BYTES = re.compile(T.TOKEN.encode())
_KEPT_WORDS = 200_000


class Embedder(Protocol):
    """What turns texts into vectors; ``column`` for tables, ``query`` for one query on the driver."""

    def column(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


def slot(token: Column, dim: int) -> Column:
    """The place of a token in a hashed vector: eight hexadecimal digits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


class _Places(dict):
    """Words' places in a hashed vector, as ``slot`` has them; at most ``_KEPT_WORDS`` are kept."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = at = int(hashlib.md5(word).hexdigest()[:8], 16) % self.dim
        return at

    def __reduce__(self):
        return _Places, (self.dim,)


class HashingEmbedder:
    """Counts of lower-cased words, hashed into ``dim`` places and scaled to length 1.

    Texts cross once, as bytes; a worker keeps the places of the words that it has met, up to a bound.
    """

    in_place = True  # to make a vector again costs less than to find its text among others

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"

    def slots(self, text: Column) -> Column:
        return F.transform(T.tokens(F.lower(text)), lambda w: slot(w, self.dim))

    def column(self, text: Column) -> Column:
        dim, places = self.dim, _Places(self.dim)

        @F.arrow_udf("array<float>")
        def counted(texts: pa.Array) -> pa.Array:
            m = np.zeros((len(texts), dim))
            for k, t in enumerate(texts):
                raw = t.as_py()
                # bytes are split at the pattern's characters and at one more
                words = raw.split() if b"\v" not in raw else re.findall(_WORD_BYTES, raw)
                if words:
                    m[k] = np.bincount([places[w] for w in words], minlength=dim)
            m = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]).astype(np.float32)
            offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim)
            return pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), pa.float32()))

        return counted(F.lower(F.coalesce(text, F.lit(""))).cast("binary"))

    def query(self, text: str) -> list[float]:
        counts = np.zeros(self.dim)
        for w in re.findall(_WORD, text.lower()):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
        return (counts / max(np.linalg.norm(counts), 1e-300)).tolist()


class KeywordEmbedder:
    """Three numbers from a text's words and length; small enough to follow by hand in tests."""

    #: Fixed values: (component, weight, phrases any of which counts); then what the two words of ``BOTH`` add together.
    WORDS = (
        (0, 0.7, ("test",)),
        (1, 0.7, ("file",)),
        (2, 0.5, ("machine learning",)),
        (0, 0.3, ("ai", "artificial intelligence")),
        (1, 0.3, ("integration",)),
        (2, 0.2, ("content",)),
    )
    BOTH = (("test", "file"), (0.3, 0.3, 0.0))

    def column(self, text: Column) -> Column:
        low, size = F.lower(text), F.octet_length(text)
        both = F.lit(True)
        for w in self.BOTH[0]:
            both = both & low.contains(w)
        out = []
        for k in range(3):
            total = (size % (100 * (k + 1))) / F.lit(1000.0 * (k + 1)) + F.when(both, self.BOTH[1][k]).otherwise(0.0)
            for at, weight, phrases in self.WORDS:
                if at == k:
                    hit = F.lit(False)
                    for p in phrases:
                        hit = hit | low.contains(p)
                    total = total + F.when(hit, weight).otherwise(0.0)
            out.append(F.least(F.lit(1.0), total))
        return F.array(*out).cast("array<float>")

    def query(self, text: str) -> list[float]:
        low, size = text.lower(), len(text.encode())
        both = all(w in low for w in self.BOTH[0])
        hit = lambda k: sum(w for at, w, phrases in self.WORDS if at == k and any(p in low for p in phrases))
        return [min(1.0, size % (100 * (k + 1)) / (1000.0 * (k + 1)) + hit(k) + (self.BOTH[1][k] if both else 0.0)) for k in range(3)]


class HttpEmbedder:
    """A client of a model server's ``/api/embeddings``, one for each worker; three more tries with growing pauses."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "nomic-embed-text", timeout: float = 30, retries: int = 3):
        self.url, self.model, self.timeout, self.retries = url.rstrip("/"), model, timeout, retries
        self.name = f"{self.url} {model}"

    def _ask(self, prompt: str) -> list[float]:
        body = json.dumps({"model": self.model, "prompt": prompt}).encode()
        request = urllib.request.Request(f"{self.url}/api/embeddings", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            vector = json.load(answer).get("embedding") or []
        if not vector:
            raise ValueError("the model server returned no embedding")
        return vector

    def embed(self, prompt: str) -> list[float]:
        if not prompt:
            raise ValueError("nothing to embed")
        for attempt in range(self.retries + 1):
            try:
                return self._ask(prompt)
            except (OSError, ValueError) as e:
                if attempt == self.retries:
                    raise RuntimeError(f"no embedding after {self.retries} retries") from e
                time.sleep((attempt + 1) ** 2 * 0.1)
        raise AssertionError

    def column(self, text: Column) -> Column:
        @F.arrow_udf("array<float>")
        def asked(texts: pa.Array) -> pa.Array:
            return pa.array([self.embed(t) if t else None for t in texts.to_pylist()], pa.list_(pa.float32()))

        return asked(text)

    def query(self, text: str) -> list[float]:
        return self.embed(text)


def name_of(embedder: Embedder) -> str:
    """What tells an embedder's vectors from those of others."""
    return getattr(embedder, "name", type(embedder).__name__)


class EmbeddingCache:
    """Vectors of texts by digest and model, kept in versioned tables across calls and sessions.

    Each call is a run: it looks its distinct texts up, embeds those that are new, and notes what it used, with how many
    requests were for it. ``evict`` drops what was used longest ago. Runs may overlap; a text that two of them embed is kept once.
    """

    TABLES = {
        "vectors": {"digest": "string", "embedding": "array<float>", "bytes": "bigint"},
        "uses": {"digest": "string", "run": "bigint", "requests": "bigint", "hit": "boolean"},
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.store = Store(spark, path, {name: Table(columns, "digest") for name, columns in self.TABLES.items()})

    def _vectors(self, state: dict) -> DataFrame:
        return self.store.read("vectors", state)

    def embed(self, texts: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
        """``texts`` with their ``embedding``; null and empty texts have none."""
        small_batches(self.spark, rows=500)
        digest = F.when(F.coalesce(text, F.lit("")) != "", F.sha2(F.concat(F.lit(name_of(embedder) + "\n"), F.col(text)), 256))
        keyed = texts.withColumn("_digest", digest)
        # what is asked is known by digests; of texts only those that are new are moved, once
        asked = keyed.where("_digest is not null").groupBy(F.col("_digest").alias("digest")).agg(F.count("*").alias("requests"))
        asked = stage(asked, "asked")
        state = self.store.state()
        known = self.store.matching("vectors", state, asked.select("digest")).select("digest", "embedding").dropDuplicates(["digest"])
        known = stage(known, "known")
        rows = keyed.where("_digest is not null").select(F.col("_digest").alias("digest"), F.col(text).alias("_t"))
        if known.head(1):
            new = asked.join(known, "digest", "left_anti").select("digest")
            rows = rows.join(limited(stage(new, "new")), "digest", "left_semi")
        each = rows.groupBy("digest").agg(F.first("_t").alias("_t"))
        fresh = stage(each.select("digest", embedder.column(F.col("_t")).alias("embedding")), "fresh")
        hit = F.col("_hit").isNotNull()
        uses = asked.join(known.select("digest", F.lit(True).alias("_hit")), "digest", "left").select("digest", "requests", hit.alias("hit"))
        ready = self.store.write("vectors", fresh.where("embedding is not null").withColumn("bytes", F.lit(4) * F.size("embedding") + 64))

        def note(_: dict, change) -> None:
            run = int(change.folder[1:].split("-")[0])
            change.add("vectors", ready)
            self.store.append("uses", change, uses.withColumn("run", F.lit(run)))

        if asked.head(1):
            self.store.commit(note)
        vectors = known.unionByName(fresh).withColumnRenamed("digest", "_digest")
        return keyed.join(vectors, "_digest", "left").drop("_digest")

    def requests(self) -> DataFrame:
        """The log: ``(digest, run, requests, hit)``, runs being numbered by version."""
        return self.store.read("uses")

    def stats(self) -> dict:
        """Requests and hits of all runs (of a text that a run asks for twice the second is a hit), and what is kept."""
        state = self.store.state()
        used = self.store.read("uses", state).agg(F.sum("requests").alias("n"), F.sum(F.when(F.col("hit"), F.col("requests")).otherwise(F.col("requests") - 1)).alias("hits")).first()
        kept = self._vectors(state).agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
        n, hits = int(used.n or 0), int(used.hits or 0)
        return {"requests": n, "hits": hits, "hit_rate": hits / n if n else 0.0, "vectors": int(kept.n), "bytes": int(kept.b or 0)}

    def evict(self, most_bytes: int) -> int:
        """Drop the vectors used longest ago until at most ``most_bytes`` are kept; how many went.

        Those of the run at the edge go by ranges of their digests. What is summed on the driver is a row for each run, and
        65,536 rows for that run.
        """
        gone = 0

        def dropped(state: dict, change) -> None:
            nonlocal gone
            last = self.store.read("uses", state).groupBy("digest").agg(F.max("run").alias("run"))
            held = stage(self._vectors(state).select("digest", "bytes").join(last, "digest", "left").withColumn("run", F.coalesce("run", F.lit(0))), "held")
            left, edge = most_bytes, None
            for r in held.groupBy("run").agg(F.sum("bytes").alias("b")).orderBy(F.desc("run")).collect():
                if r.b > left:
                    edge = r.run
                    break
                left -= r.b
            gone = 0
            if edge is None:
                return
            first = F.substring("digest", 1, 4)
            upto = ""  # digests that begin with less than this stay
            for r in held.where(F.col("run") == edge).groupBy(first.alias("p")).agg(F.sum("bytes").alias("b")).orderBy("p").collect():
                if r.b > left:
                    upto = r.p
                    break
                left -= r.b
            out = held.where((F.col("run") < edge) | ((F.col("run") == edge) & (first >= upto))).select("digest")
            gone = self.store.remove("vectors", state, change, stage(out, "evicted"))

        self.store.commit(dropped)
        return gone


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: str = "chunk_text", cache: EmbeddingCache | None = None) -> DataFrame:
    """``(chunk_id, document_id, embedding)``; each distinct processed text is embedded once, and not at all if ``cache`` has it."""
    small_batches(chunks.sparkSession, rows=500)
    ready = chunks.select("chunk_id", "document_id", T.preprocess(F.col(text)).alias("_t"))
    if cache is not None:
        return cache.embed(ready.where("_t <> ''"), embedder, "_t").where("embedding is not null").select("chunk_id", "document_id", "embedding")
    # texts are processed once, and shuffled once, to find the distinct ones; vectors go back to their chunks by digest
    keyed = stage(ready.withColumn("_key", F.sha2("_t", 256)), "keyed").where("_t <> ''")
    each = keyed.groupBy("_key").agg(F.first("_t").alias("_t")).select("_key", embedder.column(F.col("_t")).alias("embedding"))
    return keyed.select("chunk_id", "document_id", "_key").join(each, "_key").select("chunk_id", "document_id", "embedding")


def embed_in_place(chunks: DataFrame, embedder: Embedder, text: str = "chunk_text") -> DataFrame:
    """``(chunk_id, document_id, embedding)`` by an embedder that is not worth a search for equal texts; of texts without words to embed it is null."""
    small_batches(chunks.sparkSession, rows=500)
    ready = chunks.select("chunk_id", "document_id", T.preprocess(F.col(text)).alias("_t"))
    made = ready.select("chunk_id", "document_id", (F.octet_length("_t") == 0).alias("_blank"), embedder.column(F.col("_t")).alias("embedding"))
    return made.select("chunk_id", "document_id", F.when(~F.col("_blank"), F.col("embedding")).alias("embedding"))


def embed_query(spark, embedder: Embedder, query: str) -> list[float]:
    """The vector of a query; a model server gets it widened as documents are."""
    ship(spark)
    if isinstance(embedder, HttpEmbedder):
        query = spark.range(1).select(T.preprocess_query(F.lit(query))).first()[0]
    return list(embedder.query(query))


def checked(vector: Sequence[float], dim: int | None) -> Sequence[float]:
    if not len(vector) or dim is not None and len(vector) != dim:
        raise ValueError(f"a vector of {len(vector)} where {dim or 'one or more'} components are needed")
    return vector
