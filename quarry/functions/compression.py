"""Gzip of text and binary columns, for files and columns that other tools read; stored tables use Parquet's codecs."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.session import small_batches


def compress(text: Column, spark: SparkSession) -> Column:
    """Gzip of a text's UTF-8 bytes; null for an empty or null text."""
    small_batches(spark)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([gzip.compress(t.encode(), mtime=0) if t else None for t in texts.to_pylist()], pa.binary())

    return packed(text)


def decompress(data: Column, spark: SparkSession) -> Column:
    """The text of a gzip value; empty for null, an error for what is not gzip."""
    small_batches(spark)

    @F.arrow_udf("string")
    def unpacked(values: pa.Array) -> pa.Array:
        return pa.array([gzip.decompress(v).decode() if v else "" for v in values.to_pylist()], pa.string())

    return unpacked(data)
