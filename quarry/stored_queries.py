"""Queries over tables that are stored and changed: deltas, compaction, lookups, the keyword index, the cache of vectors, pruned search.

What they read is made of the shared tables by Spark, once for each session and folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.catalogue import _PHRASE, _cut, _fields, _first_vector, _q, _read, _texts, _trim, _vectors, query
from quarry.embed import EmbeddingCache, HashingEmbedder
from quarry.functions import text as T
from quarry.ids import number_of, numbered_id, numbered_sql
from quarry.operators import catalog
from quarry.operators.vector_index import VectorIndex
from quarry.plans.corpus import Corpus
from quarry.operators.pages import page_row_chunks
from quarry.session import shared_dir, small_batches
from quarry.sources import large


def _once(spark: SparkSession, kind: str, sf_dir: str, make):
    held = spark.sparkContext.__dict__.setdefault("_quarry_made", {})
    if (kind, sf_dir) not in held:
        held[kind, sf_dir] = make(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return held[kind, sf_dir]


#: What the changes make of ``documents``: every tenth text gets words, another tenth goes.
_CHANGED = """select doc_id::varchar as id, case when doc_id % 10 = 3 then coalesce(text, '') || ' and more of it' else text end as text
    from documents where doc_id % 10 <> 7 and coalesce(text, '') <> ''"""


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[Corpus, int]:
    """A corpus of all documents after two changes, and its version then."""

    def make(at: str):
        corpus = Corpus(spark, at, HashingEmbedder(16))
        docs = _texts(spark, sf_dir).where("coalesce(text, '') <> ''").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id")
        corpus.index(docs.select("id", "text"))
        corpus.index(docs.where("doc_id % 10 = 3").select("id", F.concat("text", F.lit(" and more of it")).alias("text")))
        return corpus, corpus.delete_all(docs.where("doc_id % 10 = 7").select("id"))

    return _once(spark, "corpus", sf_dir, make)


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[Corpus, int]:
    """The same corpus and its version after compaction; only for those who ask for it."""
    corpus = _corpus(spark, sf_dir)[0]

    def make(_: str):
        corpus.compact(most_parts=1)
        return corpus, corpus.manifest()["version"]

    return _once(spark, "compacted", sf_dir, make)


_STATE = f"select id, sha256(text) as content_hash, strlen(text)::int as bytes from ({_CHANGED})"


def _state(corpus: Corpus, version: int):
    docs = corpus.table("documents", corpus.manifest(version))
    return docs.select("id", "content_hash", F.octet_length("original_text").alias("bytes"))


@query(_STATE)
def stored_changes(spark, sf_dir):
    """Documents read from base files, added files and marks of gone rows."""
    return _state(*_corpus(spark, sf_dir))


@query(_STATE)
def stored_compacted(spark, sf_dir):
    """The same after compaction."""
    return _state(*_compacted(spark, sf_dir))


@query(f"select id as document_id, true as embedded, strlen(text)::bigint >= 1 as chunked from ({_CHANGED})")
def stored_parts(spark, sf_dir):
    """The documents that chunks and vectors belong to; each chunk has its vector."""
    corpus, before = _corpus(spark, sf_dir)
    at = corpus.manifest(before)
    chunks, vectors = corpus.table("chunks", at), corpus.table("embeddings", at)
    both = chunks.select("document_id", "chunk_id").join(vectors.select("document_id", "chunk_id", F.lit(True).alias("v")), ["document_id", "chunk_id"], "full")
    return both.groupBy("document_id").agg(F.min(F.coalesce("v", F.lit(False))).alias("embedded"), (F.count("chunk_id") >= 1).alias("chunked"))


@query(f"select id, sha256(text) as content_hash from ({_CHANGED}) where id in ('13', '17', '18')")
def stored_lookup(spark, sf_dir):
    """Documents by id, of which one was changed and one is gone; only files that may hold them are opened."""
    return _corpus(spark, sf_dir)[0].table("documents", keys=["13", "17", "18"]).select("id", "content_hash")


@query(f"select id as document_id, md5(text) as text_md5 from ({_CHANGED}) where id = '18'")
def stored_chunks(spark, sf_dir):
    """A document's chunks, all of them, joined in their order: its text."""
    corpus, _ = _corpus(spark, sf_dir)
    joined = catalog.joined_chunks(corpus.table("documents", keys=["18"]), corpus.chunks("18"))
    return joined.select("document_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    """with d as (select doc_id, text from documents where coalesce(text, '') <> ''), c as (select * from (
      select 1 as change, text from d union all select 2, text || ' and more of it' from d where doc_id % 10 = 3))
    select change::bigint as change, count(*)::double as documents, sum(strlen(text))::double as bytes, sum(len(regexp_extract_all(text, '[^\t\n\f\r ]+')))::double as tokens from c group by change"""
)
def recorded_metrics(spark, sf_dir):
    """What the two index runs recorded of themselves while they ran."""
    kept = _corpus(spark, sf_dir)[0].metrics().where("operation = 'index'")
    runs = kept.groupBy("at").pivot("name", ["version", "documents", "bytes", "tokens"]).agg(F.first("value"))
    return runs.select(F.col("version").cast("long").alias("change"), "documents", "bytes", "tokens")


@query(f"select doc_id, {numbered_sql('doc_id')} as id, doc_id as back from documents")
def readable_ids(spark, sf_dir):
    """An id for each document's number, and the number of each id."""
    made = _read(spark, sf_dir, "documents").select("doc_id", numbered_id(F.col("doc_id")).alias("id"))
    return made.withColumn("back", number_of(F.col("id")))


@query("select doc_id, md5(coalesce(text, '')) as text_md5, coalesce(lang, '') as lang, 3 as fields from documents")
def csv_records(spark, sf_dir):
    """All documents, written as CSV files, one by each task, and read again by ranges of them; line ends and quotes within texts are quoted."""

    def make(at: str):
        docs = _read(spark, sf_dir, "documents").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "lang", "text")])
        docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", '""').csv(at)
        return at

    rows = large.csv_records(spark, _once(spark, "csv", sf_dir, make)).where("record > 1 and error is null")
    cell = lambda k: F.get("fields", F.lit(k))
    return rows.select(cell(0).cast("long").alias("doc_id"), F.md5(cell(2).cast("binary")).alias("text_md5"), cell(1).alias("lang"), F.size("fields").alias("fields"))


_TURN_CONTEXT = f"array_to_string(list_transform(string_split({_trim('before')}, '. ')[-2:], lambda x: x), '. ')"


@query(
    f"""with p as (select conv_id::varchar as document_id, turn::bigint as page_number, text from conversations where {_trim("coalesce(text, '')")} <> ''),
    l as (select *, lag(text) over (partition by document_id order by page_number) as before from p),
    c as (select *, {_TURN_CONTEXT} as context from l)
    select document_id, page_number, md5(case when before is null or context = '' then text
      else '(Previous context: ' || case when strlen(context) > 200 then ({_cut("context", 200)}) || '...' else context end || ') ' || text end) as chunk_md5 from c"""
)
def page_rows(spark, sf_dir):
    """Turns as pages of a book for each conversation: a page's chunk begins with the end of the page before."""
    pages = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("page_number"), "text")
    made = page_row_chunks(pages)
    return made.select("document_id", "page_number", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


_TERMS = _fields(f"lower({_q(_PHRASE)})")
_SCORE = f"""(len(list_filter({_TERMS}, lambda w: contains(lower(text), w))) / len({_TERMS})
    + case when contains(lower(text), array_to_string({_TERMS}, ' ')) then 0.3 else 0.0 end)"""


@query(f"select id as document_id, round({_SCORE}, 6) as score from ({_CHANGED}) where {_SCORE} > 0.1 order by {_SCORE} desc, id limit 10")
def stored_words(spark, sf_dir):
    """Keyword search by the index that was kept through the changes."""
    return _corpus(spark, sf_dir)[0].search_words(_PHRASE, 10).withColumn("score", F.round("score", 6))


@query(
    """with d as (select text from documents where coalesce(text, '') <> ''), c as (select text from conversations where coalesce(text, '') <> ''),
    r as (select 1 as run, text, count(*) as n, false as hit from d group by text
      union all select 2, text, count(*), text in (select text from d) from (select * from c union all select * from d) group by text)
    select run::bigint as run, sum(n)::bigint as requests, count(*) as texts, coalesce(sum(n) filter (where hit), 0)::bigint as hits from r group by run"""
)
def embedding_cache(spark, sf_dir):
    """What two runs asked of the cache: all documents, then all turns and all documents again."""

    def make(at: str):
        cache, embedder = EmbeddingCache(spark, at), HashingEmbedder(16)
        docs, turns = _texts(spark, sf_dir).select("text"), _read(spark, sf_dir, "conversations").select("text")
        cache.embed(docs, embedder)
        cache.embed(turns.unionByName(docs), embedder)
        return cache

    log = _once(spark, "cache", sf_dir, make).requests()
    return log.groupBy("run").agg(F.sum("requests").alias("requests"), F.count("*").alias("texts"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("requests"))), F.lit(0)).alias("hits"))


@query(
    """select vec_id // 10 as document_id, vec_id as chunk_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score
    from embeddings order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id limit 10"""
)
def vector_topk_pruned(spark, sf_dir):
    """The nearest chunks from groups of vectors around pivots, of which some are never read."""
    first = _first_vector(spark, sf_dir)
    index = _once(spark, "pivots", sf_dir, lambda at: VectorIndex(spark, at).build(_vectors(spark, sf_dir), len(first)))
    return index.search(first, 10).select("document_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), {_q(T.TOKEN)})) as w from documents),
    n as (select doc_id, (('0x' || substr(md5(w), 1, 8))::bigint % 64)::int as slot, count(*) as n from w group by all)
    select doc_id, slot, round(n / sqrt(sum(n * n) over (partition by doc_id)), 4) as value from n"""
)
def hashing_vectors(spark, sf_dir):
    """All components of the hashed vectors that are not zero."""
    small_batches(spark)
    vectors = _texts(spark, sf_dir).select("doc_id", HashingEmbedder(64).column(F.col("text")).alias("v"))
    parts = vectors.select("doc_id", F.posexplode("v").alias("slot", "value")).where("value <> 0")
    return parts.select("doc_id", "slot", F.round(F.col("value").cast("double"), 4).alias("value"))


_AT = "timestamp '2024-01-01 00:00:00' + to_seconds((doc_id % 500)::bigint)"


@query(
    f"""with d as (select doc_id::varchar as id, {_AT} as updated_at from documents),
    r as (select id, updated_at, row_number() over (order by updated_at desc, id) as place from d),
    p as (select *, row_number() over (order by place) as k from r where updated_at < timestamp '2024-01-01 00:05:00' or (updated_at = timestamp '2024-01-01 00:05:00' and id > '3'))
    select id, updated_at, k as place from p where k <= 100"""
)
def documents_page(spark, sf_dir):
    """A page of the listing after a mark, in order."""
    at = F.timestamp_add("SECOND", (F.col("doc_id") % 500).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    docs = _texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("original_text"), F.lit("txt").alias("doc_type"), at.alias("updated_at"))
    page = catalog.page_of_documents(docs, 100, "2024-01-01T00:05:00|3").coalesce(1)
    return page.select("id", "updated_at", (F.monotonically_increasing_id() + 1).alias("place"))
