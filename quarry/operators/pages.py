"""Books whose pages are rows: chunks of pages, with the end of the page before handed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.chunking import chunk_documents
from quarry.session import stage
from quarry.sources.files import CONTEXT_BYTES, PAGE_WORDS


def _context(text: Column) -> Column:
    """The last two sentences of a chunk, cut within ``CONTEXT_BYTES``."""
    last = T.let(F.split(T.trim(text), r"\. "), lambda s: F.array_join(F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), F.lit(2)), ". "))
    return T.let(last, lambda c: F.when(F.octet_length(c) > CONTEXT_BYTES, F.concat(T.cut_bytes(c, CONTEXT_BYTES), F.lit("..."))).otherwise(c))


def page_row_chunks(pages: DataFrame, max_tokens: int = 1800, overlap: int = 200) -> DataFrame:
    """``(document_id, page_number, part, chunk_text, token_count, chunk_type)`` of ``pages(document_id, page_number, text)``.

    As ``page_chunks`` has them for a book that is one value. Pages stay rows wherever they lie: what is brought into order within
    a book are the pages' numbers, without their texts; the end of a page goes to the next by a join. Of pages that share a number the
    smallest text comes first, and all but the first go by parts of one page. Blank pages are left out.
    """
    words = F.size(T.fields(F.col("text")))
    kept = stage(pages.select("document_id", "page_number", "text").where(T.trim(F.coalesce("text", F.lit(""))) != "").withColumn("w", words), "pages")
    short = kept.where(F.col("w") <= PAGE_WORDS).select("document_id", "page_number", F.lit(0).alias("part"), F.col("text").alias("chunk_text"), F.lit("pdf_page").alias("chunk_type"))
    keyed = kept.where(F.col("w") > PAGE_WORDS).select(F.struct("document_id", "page_number").alias("at"), "text")
    parts = chunk_documents(keyed, "text", "at", max_tokens, overlap, keep_short=False)
    titled = F.concat(F.lit("Page "), F.col("document_id.page_number").cast("string"), F.lit(": "), F.col("chunk_text"))
    long = parts.select("document_id.document_id", "document_id.page_number", F.col("chunk_index").alias("part"), titled.alias("chunk_text"), F.lit("pdf_page_section").alias("chunk_type"))
    order = Window.partitionBy("document_id", "page_number").orderBy("part", "chunk_text")
    chunks = stage(short.unionByName(long).withColumn("part", F.row_number().over(order) - 1), "chunks")
    last = chunks.groupBy("document_id", "page_number").agg(F.max_by("chunk_text", "part").alias("_text"))
    numbers = chunks.select("document_id", "page_number").distinct()
    following = numbers.withColumn("_next", F.lead("page_number").over(Window.partitionBy("document_id").orderBy("page_number")))
    handed = last.join(following.where("_next is not null"), ["document_id", "page_number"]).select("document_id", F.col("_next").alias("page_number"), F.lit(0).alias("part"), _context(F.col("_text")).alias("_context"))
    out = chunks.join(handed, ["document_id", "page_number", "part"], "left")
    text = F.when(F.coalesce("_context", F.lit("")) != "", F.concat(F.lit("(Previous context: "), "_context", F.lit(") "), "chunk_text")).otherwise(F.col("chunk_text"))
    return out.select("document_id", "page_number", "part", text.alias("chunk_text"), T.token_count(text).alias("token_count"), "chunk_type")
