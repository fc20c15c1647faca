"""A corpus: documents, chunks and vectors in versioned tables, with search and chat over them.

Tables are those of ``quarry.plans.store``: a change writes its own rows and marks those that they replace, so its cost grows with the
change and not with the corpus; a lookup opens the few files that may hold the id; a search scans the vectors,
and of texts reads only those of its hits. Words are found by a keyword index that is kept with every change. Readers see one version,
never a mixture. ``compact`` tidies up what many changes leave; ``expire`` deletes old versions.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.embed import Embedder, EmbeddingCache, HashingEmbedder, checked, embed_chunks, embed_in_place, embed_query
from quarry.functions import text as T
from quarry.operators import catalog, keyword_index, search
from quarry.operators.chunking import chunk_rows, with_chunks
from quarry.plans.chat import ChatModel, answer
from quarry.plans.store import HASH, Change, Store, Table
from quarry.session import limited, release, stage, together
from quarry.sources import files as sources

TABLES = {name: Table(columns, schemas.KEYS[name]) for name, columns in schemas.TABLES.items()}
_OF_DOCUMENTS = ("documents", "chunks", "embeddings")
_LISTED_PATHS = 10_000  # changed files that are read by a list of their paths


class Corpus:
    """Verbs over one corpus folder, which may be on any file system that Spark writes to.

    ``keywords``: whether a keyword index is kept; without one, searches for words scan all texts.
    ``cache``: where vectors of texts are kept across calls.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        embedder: Embedder | None = None,
        max_tokens: int = 256,
        overlap: int = 38,
        keywords: bool = True,
        cache: EmbeddingCache | None = None,
    ):
        if overlap >= max_tokens:
            raise ValueError("overlap must be smaller than max_tokens")
        self.spark, self.path = spark, path.rstrip("/")
        self.embedder = embedder or HashingEmbedder()
        self.max_tokens, self.overlap = max_tokens, overlap
        self.keywords, self.cache = keywords, cache
        self.store = Store(spark, self.path, TABLES)

    # versions

    def manifest(self, version: int | None = None) -> dict:
        """A version (the newest), and by table what is known of each file."""
        return self.store.state(version)

    def table(self, name: str, at: dict | None = None, keys: Iterable[str] | None = None) -> DataFrame:
        """A table, as of the manifest ``at``, whole or only the rows of some keys."""
        return self.store.read(name, at, keys)

    def reads(self, name: str, *keys: str) -> tuple[int, int]:
        """How many files a lookup of ``keys`` opens, and how many the table has."""
        state = self.manifest()
        return len(self.store.entries(name, state, keys)), len(self.store.entries(name, state))

    def compact(self, most_parts: int = 8, most_gone: float = 0.2) -> dict[str, int]:
        """Merge what many changes have left in pieces; how many files, by table. It may run beside other writers."""
        merges = {"postings": lambda rows: _netted(rows, HASH), "words": lambda rows: rows.distinct()}
        return {name: self.store.compact(name, most_parts, most_gone, merges.get(name)) for name in TABLES}

    def expire(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep``, and the folders that only they use; how many went.

        Not while another writer is at work: what it has not yet published is in use by no version.
        """
        return self.store.expire(keep)

    def reset(self, force: bool = False) -> None:
        """Delete the corpus."""
        if not force:
            raise ValueError("pass force=True to delete the corpus")
        self.store.delete_path(self.path)

    def keep_file(self, name: str, data: bytes) -> str:
        """Put a file's bytes beside the tables, where executors see them too; its path."""
        return self.store.write_bytes(f"{self.path}/files/{name}", data)

    def read_file(self, path: str) -> bytes:
        data = self.store.read_bytes(path)
        if data is None:
            raise KeyError("the file is gone")
        return data

    # what jobs record of themselves

    def record(self, operation: str, **values: float) -> None:
        """Add what an operation measured to the metrics table: one small file, which nothing ever rewrites."""
        now = time.time()
        rows = "".join(json.dumps({"operation": operation, "name": k, "value": float(v), "at": now}) + "\n" for k, v in values.items())
        self.store.write_bytes(f"{self.path}/metrics/{now:.6f}-{uuid.uuid4().hex[:8]}.json", rows.encode())

    def metrics(self) -> DataFrame:
        """``(operation, name, value, at)``: what indexing and searching recorded, for ``quarry.operators.metrics``."""
        schema = "operation string, name string, value double, at double"
        fs, at = self.store.fs(f"{self.path}/metrics")
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/metrics").withColumn("at", F.timestamp_seconds("at"))

    # changes

    def index(self, docs: DataFrame, doc_type: str = "", batch: tuple[str, int] | None = None) -> int:
        """Add or replace ``docs(id, text)``: chunks, vectors and documents in one version.

        ``batch``: a stream and the number of its batch; one that is already in the corpus is not indexed again.
        """
        if batch and self.manifest()["notes"].get("batches", {}).get(batch[0], -1) >= batch[1]:
            return self.manifest()["version"]
        # of rows that share an id the one with the smallest text counts
        rows = _smallest(docs.select(F.col("id").cast("string").alias("id"), "text"))
        # texts are read and split once; documents and chunks are both taken from here
        rows = stage(with_chunks(rows, "text", self.max_tokens, self.overlap), "texts")
        chunks = chunk_rows(rows).withColumn("page_number", F.lit(None).cast("int"))
        version = self._put(rows.drop("chunks").withColumns({"source_path": F.lit(None).cast("string"), "doc_type": F.lit(doc_type)}), chunks, batch=batch)
        release(rows)
        return version

    def index_files(self, path: str, parsers=None, changed_only: bool = False, retire: bool = False) -> dict:
        """Parse and index the files under ``path``; an id is the file's name without extension.

        What comes back: the ``version``, how many files were ``indexed``, how many ``failed``, and up to a
        hundred of these with their errors. A file fails that can't be read or holds no text, and so
        do all but the first, by path, of those that would have the same id.

        ``changed_only``: files of the length and time at which they were last indexed are not opened, and of the
        others those with the same content are not parsed; ``unchanged`` counts both. ``retire``: documents of files under ``path`` that are
        no longer there are deleted; ``retired`` counts them.
        """
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        there = listed.select("path", "length", F.col("modificationTime").alias("modified_at"))
        known, total, retired = self.table("files"), None, 0
        if changed_only or retire:
            there = stage(there, "listing")
            total = there.count()
        if changed_only:
            same = there.join(known, ["path", "length", "modified_at"], "left_semi").select("path")
            changed = stage(there.join(same, "path", "left_anti").select("path"), "changed")
            paths = [r.path for r in changed.limit(_LISTED_PATHS + 1).collect()]
            listed = self.spark.read.format("binaryFile").load(paths) if 0 < len(paths) <= _LISTED_PATHS else listed.join(changed, "path", "left_semi")
        hashed = listed.select("path", "content", "length", F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("file_hash"))
        if changed_only:
            hashed = hashed.join(known.select("path", F.col("content_hash").alias("file_hash")), ["path", "file_hash"], "left_anti")
        marks = stage(hashed.select("path", "length", "modified_at", "file_hash"), "marks")
        parsed = sources.parse_files(hashed.join(marks.select("path"), "path", "left_semi") if changed_only else hashed, True, parsers)
        parsed = stage(parsed, "parsed").withColumn("id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
        empty = F.when(F.coalesce("text", F.lit("")) == "", F.lit("no text"))
        parsed = parsed.withColumn("problem", F.coalesce("error", empty))
        claims = parsed.where("problem is null").select("id", "path")
        if changed_only:  # an unchanged file keeps its id
            claims = claims.unionByName(known.join(marks, "path", "left_anti").join(there, "path", "left_semi").select(F.col("document_id").alias("id"), "path"))
        first = claims.groupBy("id").agg(F.min("path").alias("first"))
        parsed = parsed.join(first, "id", "left")
        parsed = parsed.withColumn("problem", F.coalesce("problem", F.when(F.col("path") != F.col("first"), F.concat(F.lit("has the id of "), "first"))))
        good, bad = parsed.where("problem is null"), parsed.where("problem is not null")
        rows = good.select("id", "text", F.col("path").alias("source_path"), "doc_type")
        chunks = good.select(F.col("id").alias("document_id"), F.explode("chunks").alias("c")).select("document_id", "c.*")
        chunks = chunks.withColumn("chunk_id", T.chunk_id(F.col("document_id"), F.col("chunk_index")))
        indexed, failed = good.count(), bad.count()
        self.record("index_files", indexed=indexed, failed=failed)
        files = good.select("path", F.col("id").alias("document_id")).join(marks, "path")
        files = files.select("path", "length", "modified_at", F.col("file_hash").alias("content_hash"), "document_id")
        version = self._put(rows, chunks, files=files) if indexed else self.manifest()["version"]
        if retire:
            under = known.where(F.col("path").startswith(F.lit(self._prefix(path))))
            lost = stage(under.join(there, "path", "left_anti").select("path", "document_id"), "lost")
            retired = lost.count()
            if retired:
                version = self._retire(lost)
        out = {"version": version, "indexed": indexed, "failed": failed}
        out["errors"] = [r.asDict() for r in bad.select("path", F.col("problem").alias("error")).orderBy("path").limit(100).collect()]
        return out | ({"unchanged": total - indexed - failed, "retired": retired} if total is not None else {})

    def sync_files(self, path: str, parsers=None) -> dict:
        """Index what is new or changed under ``path``, and delete what is gone from there."""
        return self.index_files(path, parsers, changed_only=True, retire=True)

    def _prefix(self, path: str) -> str:
        fs, at = self.store.fs(path)
        return str(fs.makeQualified(at).toString()).rstrip("/") + "/"

    def _words(self, texts: DataFrame, n: int) -> DataFrame:
        return keyword_index.words_of(texts, "id", "text").withColumn("n", F.lit(n))

    def _turn_words(self, change: Change, new: DataFrame | None, old: DataFrame) -> None:
        """Keep the keyword index: words that came into documents and words that left them; both tables are ``(id, text)``."""
        if not self.keywords:
            return
        if new is None:
            turned = self._words(old, -1)
        elif old.head(1):
            turned = _netted(self._words(old, -1).unionByName(self._words(new, 1)))
        else:  # nothing to take back: a document's words are distinct as they are
            turned = self._words(new, 1)
        turned = self.store.append("postings", change, turned)
        if new is not None:
            self.store.append("words", change, turned.where("n > 0").select("word").distinct())

    def _put(self, rows: DataFrame, chunks: DataFrame, batch: tuple[str, int] | None = None, files: DataFrame | None = None) -> int:
        """Publish documents ``rows(id, text, source_path, doc_type)``, which may have their ``tokens`` and ``chunk_count``, and their chunks.

        Both are read several times, and come from what is staged.
        """
        now, began = F.current_timestamp(), time.time()
        # counted while the tables are written, in no pass of their own
        of_chunks, of_docs = Observation(), Observation()
        chunks = chunks.withColumn("created_at", now)
        counted = chunks.observe(of_chunks, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("chunk_tokens"))
        if self.cache is None and getattr(self.embedder, "in_place", False):
            vectors = stage(embed_in_place(counted, self.embedder), "vectors")
            lacking = vectors.where("embedding is null")
        else:
            vectors = stage(embed_chunks(counted, self.embedder, cache=self.cache), "vectors")
            lacking = catalog.unmatched(chunks, vectors)
        if lacking.head(1):
            raise ValueError("a chunk has no vector")
        if "chunk_count" not in rows.columns:
            counts = stage(chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count")), "counts")
            rows = stage(rows.join(limited(counts), rows.id == counts.document_id, "left").drop("document_id"), "documents")
        docs = rows.select(
            "id",
            F.col("text").alias("original_text"),
            T.content_hash(F.col("text")).alias("content_hash"),
            F.lit(None).cast("string").alias("file_path"),
            "source_path",
            "doc_type",
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            now.alias("created_at"),
            now.alias("updated_at"),
            (F.col("tokens") if "tokens" in rows.columns else T.token_count(F.col("text"))).alias("_tokens"),
        )
        sums = {"bytes": F.octet_length("original_text"), "tokens": F.col("_tokens")}
        docs = docs.observe(of_docs, F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()]).drop("_tokens")
        ids = rows.select("id")
        # what does not depend on the state is written once, however often the change must be made
        ready = dict(zip(("chunks", "embeddings"), together(lambda: self.store.write("chunks", chunks), lambda: self.store.write("embeddings", vectors))))
        known = self.store.known(ids)
        picked = ids if known is None else known

        def put(state: dict, change: Change) -> None:
            old = stage(self.store.matching("documents", state, picked).select("id", F.col("original_text").alias("text"), F.col("created_at").alias("_first")), "old")
            dated = docs
            if old.head(1):
                dated = docs.join(limited(old.select("id", "_first")), "id", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
            together(
                *[lambda name=name: self.store.remove(name, state, change, picked) for name in _OF_DOCUMENTS],
                lambda: self.store.append("documents", change, dated, docs),
                lambda: self._turn_words(change, rows.select("id", "text"), old),
            )
            for name, entries in ready.items():
                change.add(name, entries)
            if files is not None:
                self.store.remove("files", state, change, files.select("path"))
                self.store.append("files", change, files)
            if batch:
                change.note("batches", *batch)

        version = self.store.commit(put)
        for t in (vectors, rows):
            release(t)
        self.record("index", version=version, seconds=time.time() - began, **of_docs.get, **of_chunks.get)
        return version

    def _drop(self, state: dict, change: Change, gone: DataFrame) -> None:
        known = self.store.known(gone)
        picked = gone if known is None else known
        old = stage(self.store.matching("documents", state, picked).select("id", F.col("original_text").alias("text")), "old")
        together(*[lambda name=name: self.store.remove(name, state, change, picked) for name in _OF_DOCUMENTS], lambda: self._turn_words(change, None, old))

    def _retire(self, lost: DataFrame) -> int:
        def retired(state: dict, change: Change) -> None:
            # not documents that have since come from another file
            own = self.store.matching("documents", state, lost.select(F.col("document_id").alias("id"))).select("id", "source_path")
            gone = stage(own.join(lost, (own.id == lost.document_id) & (own.source_path == lost.path), "left_semi").select("id"), "gone")
            self._drop(state, change, gone)
            self.store.remove("files", state, change, lost.select("path"))

        return self.store.commit(retired)

    def delete(self, *ids: str) -> int:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")

        def deleted(state: dict, change: Change) -> None:
            if self.store.matching("documents", state, gone).count() < len(set(ids)):
                raise KeyError("no such document")
            self._drop(state, change, gone)

        return self.store.commit(deleted)

    def delete_all(self, ids: DataFrame) -> int:
        """Delete the documents of ``ids(id)`` that are there, in one version."""
        gone = stage(ids.select(F.col("id").cast("string").alias("id")).distinct(), "gone")
        return self.store.commit(lambda state, change: self._drop(state, change, gone))

    @staticmethod
    def _owners(chunk_id: str) -> list[str]:
        """Ids of documents that may have a chunk of that id."""
        m = re.fullmatch(r"(.+)_chunk_\d+", chunk_id, re.S)
        return [chunk_id] + ([m[1]] if m else [])

    def update_chunk(self, chunk_id: str, text: str) -> int:
        """Replace a chunk's text and vector."""
        edits = self.spark.createDataFrame([(chunk_id, text)], "chunk_id string, chunk_text string")
        owners = self.spark.createDataFrame([(i,) for i in self._owners(chunk_id)], "document_id string")

        def edited(state: dict, change: Change) -> None:
            old = stage(self.store.matching("chunks", state, owners, places=True).where(F.col("chunk_id") == chunk_id), "old")
            if not old.head(1):
                raise KeyError("no such chunk")
            new = stage(catalog.update_chunks(old.drop("_file", "_row"), edits), "new")
            self.store.mark("chunks", change, old.select("_file", "_row"))
            self.store.append("chunks", change, new)
            vectors = self.store.matching("embeddings", state, owners, places=True).where(F.col("chunk_id") == chunk_id)
            self.store.mark("embeddings", change, vectors.select("_file", "_row"))
            self.store.append("embeddings", change, stage(embed_chunks(new, self.embedder, cache=self.cache), "vectors"))

        return self.store.commit(edited)

    def update_source_path(self, id_: str, path: str) -> int:
        gone = self.spark.createDataFrame([(id_,)], "id string")

        def moved(state: dict, change: Change) -> None:
            old = stage(self.store.matching("documents", state, gone, places=True), "old")
            if not old.head(1):
                raise KeyError("no such document")
            self.store.mark("documents", change, old.select("_file", "_row"))
            self.store.append("documents", change, catalog.update_source_path(old.drop("_file", "_row"), id_, path))

        return self.store.commit(moved)

    # lookups

    def documents(self) -> DataFrame:
        return catalog.list_documents(self.table("documents"))

    def page(self, limit: int = 100, after: str | None = None) -> tuple[list[dict], str | None]:
        """Documents without their texts, last updated first: at most ``limit``, and where the next page begins (None: nowhere)."""
        found = catalog.page_of_documents(self.table("documents"), limit + 1, after).collect()
        rows = [r.asDict() for r in found[:limit]]
        return rows, catalog.page_mark(rows[-1]["updated_at"], rows[-1]["id"]) if len(found) > limit else None

    def document(self, id_: str) -> dict:
        found = self.table("documents", keys=[id_]).head(1)
        if not found:
            raise KeyError("no such document")
        return found[0].asDict()

    def chunks(self, id_: str) -> DataFrame:
        return catalog.document_chunks(self.table("chunks", keys=[id_]), id_)

    def chunk(self, chunk_id: str) -> dict:
        found = catalog.get_chunk(self.table("chunks", keys=self._owners(chunk_id)), chunk_id).head(1)
        if not found:
            raise KeyError("no such chunk")
        return found[0].asDict()

    def health(self) -> dict:
        state = self.manifest()
        files = state["tables"].get("documents", {}).values()
        return {"status": "ok", "version": state["version"], "documents": sum(e["rows"] - sum(n for _, n in e.get("gone", [])) for e in files)}

    # retrieval

    def search_words(self, query: str, limit: int | None = None, state: dict | None = None) -> DataFrame:
        """``(document_id, score)`` of documents that hold the query's terms, by the keyword index if there is one."""
        state = state or self.manifest()
        if not self.keywords:
            return search.keyword_search(self.table("documents", state), query, limit, "original_text", "id")
        return keyword_index.search(
            self.spark,
            query,
            limit,
            # a folder that was begun with a table of n-grams lacks the words of that time
            lambda grams: keyword_index.words_with(self.store.read("postings" if "grams" in state["tables"] else "words", state), grams),
            lambda words: _live(self.store.matching("postings", state, words)),
            lambda ids: self.store.matching("documents", state, ids).select(F.col("id").alias("document_id"), F.col("original_text").alias("text")),
        )

    def search(self, query: str, limit: int | None = None, vector: Sequence[float] | None = None) -> DataFrame:
        """``(rank, id, text, score, metadata, fallback_search)``: by vectors, and by words where the query calls for them.

        Vectors are scanned; of documents and chunks only the rows of the hits are read.
        """
        if not query:
            raise ValueError("the query is empty")
        began = time.time()
        vector = checked(vector if vector is not None else embed_query(self.spark, self.embedder, query), None)
        state, n = self.manifest(), search.limit_of(limit)
        near = search.search_vectors(self.table("embeddings", state), vector, n).collect()  # at most the limit's rows
        worded = self.spark.range(1).select(F.coalesce(T.needs_keywords(F.lit(query)), F.lit(False))).first()[0]
        seen = {r.document_id for r in near}
        words = [r for r in self.search_words(query, n, state).collect() if r.document_id not in seen] if worded else []
        hits = [(k + 1, r.document_id, r.chunk_id, float(r.score), False) for k, r in enumerate(near)]
        hits += [(len(near) + k + 1, r.document_id, None, float(r.score), True) for k, r in enumerate(words)]
        found = self.spark.createDataFrame(hits, "rank int, document_id string, chunk_id string, score double, fallback_search boolean")
        docs = self.table("documents", state, [h[1] for h in hits])
        chunks = self.table("chunks", state, [h[1] for h in hits if h[2]])
        self.record("search", seconds=time.time() - began, results=len(hits), by_words=len(words))
        return search.shaped_hits(found, chunks, docs).select("rank", "id", "text", "score", "metadata", "fallback_search").orderBy("rank")

    def chat(self, message: str, model: ChatModel, limit: int | None = None) -> dict:
        """An answer from the documents found, with its sources."""
        return answer(message, model, lambda q: self.search(q, search.limit_of(limit, 20, 5)))


def _smallest(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` with the smallest text of each id; only texts of ids that come twice are shuffled. None may be without id or text."""
    bad = (F.coalesce("id", F.lit("")) == "") | (F.coalesce("text", F.lit("")) == "")
    odd = stage(docs.groupBy("id").agg(F.count("*").alias("_n"), F.max(bad).alias("_bad")).where("_n > 1 or _bad"), "odd")
    if odd.where("_bad").head(1):
        raise ValueError("a document without id or text")
    if not odd.head(1):
        return docs
    twice = limited(odd.select("id"))
    again = docs.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return docs.join(twice, "id", "left_anti").unionByName(again)


def _netted(postings: DataFrame, *more: str) -> DataFrame:
    """Words' coming and going summed up. A sum below 0 stays: what it takes back lies in parts that were not read."""
    return postings.groupBy(*more, "word", "document_id").agg(F.sum("n").cast("int").alias("n")).where("n <> 0")


def _live(postings: DataFrame) -> DataFrame:
    """The words that are in their documents now."""
    return _netted(postings).where("n > 0")
