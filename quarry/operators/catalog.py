"""Changes and lookups of stored tables, as DataFrames in and DataFrames out."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with every row replaced whose ``key`` is in ``new``."""
    ids = new.select(key).distinct()
    return old.join(ids, key, "left_anti").unionByName(new.select(old.columns))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Like ``upsert`` by ``id``; a document keeps the time at which it was first created."""
    first = old.select("id", F.col("created_at").alias("_first"))
    dated = new.join(first, "id", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first")
    return upsert(old, dated, "id")


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows whose ``key`` is in the one column of ``ids``."""
    gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return table.join(gone, key, "left_anti")


def update_chunks(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Chunks with the text of ``edits(chunk_id, chunk_text)``, and the token count and end that go with it."""
    new = edits.select("chunk_id", F.col("chunk_text").alias("_text"))
    changed = F.col("_text").isNotNull()
    out = chunks.join(new, "chunk_id", "left").withColumns({
        "chunk_text": F.coalesce("_text", "chunk_text"),
        "token_count": F.when(changed, T.token_count(F.col("_text"))).otherwise(F.col("token_count")),
        "end_pos": F.when(changed, F.octet_length("_text")).otherwise(F.col("end_pos")),
    })
    return out.select(chunks.columns)


def update_source_path(docs: DataFrame, id_: str, path: str, now: Column | None = None) -> DataFrame:
    hit = F.col("id") == id_
    return docs.withColumns({
        "source_path": F.when(hit, F.lit(path)).otherwise(F.col("source_path")),
        "updated_at": F.when(hit, F.current_timestamp() if now is None else now).otherwise(F.col("updated_at")),
    })


def list_documents(docs: DataFrame) -> DataFrame:
    shown = docs.withColumn("is_image", F.coalesce(F.col("doc_type") == "image", F.lit(False)))
    return shown.orderBy(F.desc("updated_at"), "id")


def page_mark(updated_at: datetime.datetime, id_: str) -> str:
    """Where a page of the listing ends."""
    return f"{updated_at.isoformat()}|{id_}"


def page_of_documents(docs: DataFrame, limit: int, after: str | None = None) -> DataFrame:
    """A page of ``list_documents`` without texts, after the mark where the last one ended; each task keeps its own first rows."""
    if after is not None:
        at, _, id_ = after.partition("|")
        when = F.lit(datetime.datetime.fromisoformat(at))
        docs = docs.where((F.col("updated_at") < when) | ((F.col("updated_at") == when) & (F.col("id") > id_)))
    return list_documents(docs.drop("original_text")).limit(limit)


def get_document(docs: DataFrame, id_: str) -> DataFrame:
    return docs.where(F.col("id") == id_)


def document_chunks(chunks: DataFrame, id_: str) -> DataFrame:
    return chunks.where(F.col("document_id") == id_).orderBy("chunk_index")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def file_name(id_: Column, content_hash: Column) -> Column:
    """The name of a document's content file."""
    return F.concat(id_, F.lit("_"), F.substring(content_hash, 1, 8), F.lit(".txt.gz"))


def write_content_files(docs: DataFrame, at: str) -> DataFrame:
    """Write each text of ``docs(id, original_text, content_hash)`` gzipped under its ``file_name``, and give ``(id, file_path)``.

    Each name is a folder with one file of one text. For handing documents to other tools: a file for
    each document is more than most file systems take of a large table.
    """
    named = docs.select("id", "original_text", file_name(F.col("id"), F.col("content_hash")).alias("file_name"))
    named.select(F.col("original_text").alias("value"), "file_name").write.partitionBy("file_name").option("compression", "gzip").option("lineSep", "\x00").text(at)
    return named.select("id", F.concat(F.lit(f"{at.rstrip('/')}/file_name="), "file_name").alias("file_path"))


def _bare(words: Column) -> Column:
    return F.transform(words, lambda w: F.rtrim(w, F.lit(".!?")))


def joined_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(document_id, text)`` of ``docs(id, original_text, chunk_count)``: the words of all ``chunks`` in their order, those that overlaps repeat once.

    Units lose blanks and the mark at a sentence's end, so what lies between words is taken from the document, as is what follows the last
    chunk (text after the last sentence mark is in no unit). Each chunk goes on where those before it end, or begins within the last of
    their words: at the last place where all its words follow each other in the text. A document whose chunks are not all there, or of
    which one is not found so, has no row.
    """
    parts = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", T.tokens(F.col("chunk_text")).alias("w")))).alias("parts"))
    both = docs.join(parts, docs["id"] == parts["document_id"]).where(F.size("parts") == F.col("chunk_count"))
    both = both.select("document_id", "original_text", "parts", T.tokens(F.col("original_text")).alias("own")).withColumn("bare", _bare(F.col("own")))

    def follow(held: Column, part: Column) -> Column:
        w, n = part["w"], F.size(part["w"])
        places = F.sequence(F.greatest(F.size(held) - n, F.lit(0)), F.size(held))
        fits = F.filter(places, lambda at: F.slice(F.col("bare"), at + 1, n) == _bare(w))
        return F.when(held.isNotNull() & (F.size(fits) > 0), F.concat(F.slice(held, F.lit(1), F.array_max(fits)), w))

    words = F.aggregate("parts", F.array().cast("array<string>"), follow)
    found = both.withColumn("words", words).where("words is not null")
    whole = F.zip_with("own", "words", lambda a, b: F.when(b.isNull(), a).when(F.startswith(a, b), F.concat(b, F.substr(a, F.length(b) + 1))).otherwise(b))
    between = F.split("original_text", T.TOKEN)
    text = F.array_join(F.zip_with(between, whole, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return found.select("document_id", text.alias("text"))


def unmatched(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without a vector, and vectors without a chunk."""
    a = chunks.join(embeddings, "chunk_id", "left_anti").select("chunk_id", F.lit("no vector").alias("problem"))
    return a.unionByName(embeddings.join(chunks, "chunk_id", "left_anti").select("chunk_id", F.lit("no chunk").alias("problem")))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Of documents with equal text the one with the smallest id: ``(content_hash, id, copies)``."""
    hashed = docs.select(T.content_hash(F.col(text)).alias("content_hash"), F.col(id_).alias("id"))
    return hashed.groupBy("content_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
