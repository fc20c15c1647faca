"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for one document in five, by the CRC-32 of its id as text. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, most_bytes: int, seed: int) -> DataFrame:
    """At most ``limit`` rows ``(doc_id, y, text, _order)`` of at most ``most_bytes`` in all that are labelled and not held out.

    In one partition and in order: the rows with the smallest seeded hash of their
    id among the documents that are there, so the choice does not depend on
    partitioning. Texts are whole; one of over a sixteenth of ``most_bytes`` is
    left out, and the sample ends where the next text would exceed ``most_bytes``.
    A document labelled more than once has its largest label; null labels and ids,
    and labels that are NaN, are left out; of rows that share an id the longest (of
    those the smallest) text counts. The sample's ids are bounded by ``limit``, so they are broadcast.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y") & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    own = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    sizes = own.select("_doc", F.octet_length("_text").cast("long").alias("_size")).groupBy("_doc").agg(F.max("_size").alias("_size"))
    first = (
        known.join(sizes.where(F.col("_size") <= most_bytes // 16), F.col("_id") == F.col("_doc"))
        .select("_id", "_y", "_size", F.xxhash64(F.lit(seed), "_id").alias("_order"))
        .orderBy("_order", "_id")
        .limit(limit)
    )
    upto = F.sum("_size").over(Window.orderBy("_order", "_id"))  # over at most ``limit`` rows
    chosen = first.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).drop("_upto")
    rows = own.join(F.broadcast(chosen), (F.col("_doc") == F.col("_id")) & (F.octet_length("_text") == F.col("_size")))
    rows = rows.groupBy("_id", "_y", "_order").agg(F.min("_text").alias("_text"))
    rows = rows.select(F.col("_id").alias("doc_id"), F.col("_y").alias("y"), F.col("_text").alias("text"), "_order")
    return rows.repartition(1).sortWithinPartitions("_order", "doc_id")


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
