"""Vector, keyword and hybrid search over chunk vectors and documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import small_batches

DEFAULT_LIMIT = 10


def limit_of(limit: int | None, most: int | None = None, default: int = DEFAULT_LIMIT) -> int:
    """A requested number of results: ``default`` if none or not positive, at most ``most``."""
    out = default if limit is None or limit <= 0 else limit
    return out if most is None else min(out, most)


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a vector is null or zero or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to one fixed vector, by one Arrow pass of matrix products.

    A null, zero, or differently long vector has none.
    """
    q = np.asarray(query, dtype=np.float64)
    if q.ndim != 1 or not len(q):
        raise ValueError("the query vector is empty")
    length = float(np.linalg.norm(q))

    @F.arrow_udf("double")
    def similarity(vectors: pa.Array) -> pa.Array:
        sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), vectors.value_lengths().fill_null(-1).to_numpy(), -1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out, good = np.full(len(vectors), np.nan), sizes == len(q)
        if good.all():
            m = flat.reshape(-1, len(q))
        else:
            kept = vectors.filter(pa.array(good))
            m = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
        with np.errstate(all="ignore"):
            out[good] = (m @ q) / (np.sqrt(np.einsum("ij,ij->i", m, m)) * length)
        return pa.array(out, pa.float64(), mask=~np.isfinite(out))

    return similarity(vector)


def top_chunks(vectors: DataFrame, query: Sequence[float], limit: int | None = None, vector: str = "embedding", ties: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """The ``limit`` chunks nearest to the query, with ``score``; each partition keeps its own best before they meet."""
    small_batches(vectors.sparkSession, rows=8192)
    scored = vectors.withColumn("score", cosine_to(F.col(vector), query)).drop(vector).where("score is not null")
    return scored.orderBy(F.desc("score"), *ties).limit(limit_of(limit))


def best_per_document(chunks: DataFrame, document: str = "document_id", ties: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Each document's best chunk."""
    first = Window.partitionBy(document).orderBy(F.desc("score"), *ties)
    return chunks.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def search_vectors(vectors: DataFrame, query: Sequence[float], limit: int | None = None, dedup_first: bool = False, document: str = "document_id") -> DataFrame:
    """Nearest documents by their best chunk, best first.

    As a rule the limit counts chunks before documents are told apart, so fewer
    documents may come back; ``dedup_first`` counts documents.
    """
    n = limit_of(limit)
    if dedup_first:
        small_batches(vectors.sparkSession, rows=8192)
        scored = vectors.withColumn("score", cosine_to(F.col("embedding"), query)).drop("embedding").where("score is not null")
        return best_per_document(scored, document).orderBy(F.desc("score"), document).limit(n)
    return best_per_document(top_chunks(vectors, query, n), document).orderBy(F.desc("score"), document).limit(n)


def search_batch(vectors: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT, block: int = 4096, query_block: int = 512) -> DataFrame:
    """``(query_id, document_id, chunk_id, score, rank)``: nearest chunks, then documents, for a table of queries.

    Vectors and queries are dealt into blocks of bounded size; each pair of
    blocks is one matrix product, and a query's best of all blocks are merged.
    Both tables are counted first.
    """
    spark, k = vectors.sparkSession, limit_of(limit)
    small_batches(spark)
    n, nq = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-nq // query_block))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "document_id": [], "chunk_id": [], "score": []}
        if len(left) and len(right):
            unit = lambda t: (lambda m: m / np.linalg.norm(m, axis=1)[:, None])(np.array(t.column("v").to_pylist(), dtype=np.float64))
            with np.errstate(all="ignore"):
                score = unit(right) @ unit(left).T
            ids, docs = left.column("chunk_id").to_numpy(), left.column("document_id").to_numpy()
            for q, row in zip(right.column("query_id").to_pylist(), score):
                at = np.flatnonzero(np.isfinite(row))
                if len(at) > k:
                    edge = np.partition(row[at], len(at) - k)[len(at) - k]
                    at = at[row[at] >= edge]
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                out["query_id"] += [q] * len(at)
                out["document_id"] += docs[at].tolist()
                out["chunk_id"] += ids[at].tolist()
                out["score"] += row[at].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "document_id": pa.array(out["document_id"], pa.int64()), "chunk_id": pa.array(out["chunk_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    a = vectors.select(F.col("chunk_id").cast("long"), F.col("document_id").cast("long"), doubles(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("b"))
    a = a.where("v is not null").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("pair", F.col("b") * query_blocks + F.col("p"))
    b = queries.select(F.col("query_id").cast("long"), doubles(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("p"))
    b = b.where("v is not null").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("pair", F.col("b") * query_blocks + F.col("p"))
    pairs = a.select("pair", "chunk_id", "document_id", "v").groupBy("pair").cogroup(b.select("pair", "query_id", "v").groupBy("pair"))
    found = pairs.applyInArrow(best, "query_id long, document_id long, chunk_id long, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = found.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= k).drop("_k")
    own = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "chunk_id")
    docs = top.withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")))


def keyword_search(docs: DataFrame, query: str, limit: int | None = None, text: str = "text", id_: str = "doc_id", least: float = 0.1) -> DataFrame:
    """``(document_id, score)`` of documents that hold the query's terms, best first."""
    scored = docs.select(F.col(id_).alias("document_id"), T.keyword_score(F.col(text), F.lit(query)).alias("score"))
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), "document_id").limit(limit_of(limit))


def merge(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Vector hits in their order, then keyword hits for other documents; ``rank`` runs through both.

    Both are results of a search, with at most its limit of rows.
    """
    keyed = lambda df, source: df.select("document_id", "score", F.lit(source).alias("source"))
    rest = keyword_hits.join(vector_hits.select("document_id"), "document_id", "left_anti")
    both = keyed(vector_hits, 0).unionByName(keyed(rest, 1))
    order = Window.partitionBy(F.lit(0)).orderBy("source", F.desc("score"), "document_id")
    return both.withColumn("rank", F.row_number().over(order)).withColumn("fallback_search", F.col("source") == 1).drop("source")


def with_keywords(hits: DataFrame, docs: DataFrame, query: str, limit: int | None = None, strict_limit: bool = False) -> DataFrame:
    """Vector hits, and keyword hits after them for queries that call for exact words.

    Up to twice the limit may come back, unless ``strict_limit``.
    """
    if not query:
        raise ValueError("the query is empty")
    n = limit_of(limit)
    words = keyword_search(docs, query, n)
    if not docs.sparkSession.range(1).select(F.coalesce(T.needs_keywords(F.lit(query)), F.lit(False))).first()[0]:
        words = words.limit(0)
    out = merge(hits, words)
    return out.where(F.col("rank") <= n) if strict_limit else out


def hybrid_search(vectors: DataFrame, docs: DataFrame, query: str, embedding: Sequence[float], limit: int | None = None, strict_limit: bool = False) -> DataFrame:
    """Vector search, with keyword search added where the query calls for it."""
    return with_keywords(search_vectors(vectors, embedding, limit), docs, query, limit, strict_limit)


def shaped_hits(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits(document_id, chunk_id, score, ...)`` with the documents' ``id`` and whole ``text``, and ``metadata`` where a chunk was hit."""
    own = chunks.drop("document_id").withColumnRenamed("chunk_id", "_chunk").withColumnRenamed("created_at", "_created")
    found = hits.join(own, F.col("chunk_id") == F.col("_chunk"), "left").join(docs.withColumnRenamed("id", "document_id"), "document_id")
    metadata = F.struct(
        "chunk_index",
        "chunk_type",
        ((F.col("chunk_index") > 0) | (F.col("chunk_count") > 1)).alias("is_chunk"),
        F.col("original_text"),
        F.col("chunk_text").alias("matching_chunk"),
        "page_number",
        "file_path",
        "source_path",
        "doc_type",
        (F.coalesce(F.col("doc_type"), F.lit("")) == "image").alias("is_image"),
    )
    extra = [c for c in hits.columns if c not in ("document_id", "chunk_id", "score")]
    return found.select(F.col("document_id").alias("id"), F.col("original_text").alias("text"), "score", F.when(F.col("_chunk").isNotNull(), metadata).alias("metadata"), *extra)


def shaped(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Results as an API returns them: ``id``, whole ``text``, ``score`` and ``metadata``."""
    found = shaped_hits(hits.select("document_id", "chunk_id", "score"), chunks, docs)
    return found.where("metadata is not null").orderBy(F.desc("score"), "id")
