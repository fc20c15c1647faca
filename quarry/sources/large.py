"""CSV files of any size as rows: byte ranges of a file are read side by side, and records are put together across them.

Spark reads a file's lines by ranges. Whether a line begins within quotes is the parity of the quotes before it: those of the ranges
before, a number for each, and those of its own range. Lines that begin outside are where records begin.
"""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.chunking import pack_table
from quarry.session import limited, small_batches, stage


def _before(blocks: DataFrame, value: str) -> DataFrame:
    """``blocks`` with the sum of ``value`` over the ranges of the file before each; a row for each range."""
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_before", F.coalesce(F.sum(value).over(order), F.lit(0)))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record, fields, error)`` of the CSV files under ``path``: records of each file from 1, blank ones left out.

    Quotes count where fields begin, as in well-formed files; a record that can't be read, or that has another number of
    fields than the file's first one, has its ``error``. Fields stay strings. Line ends within quotes are kept.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))
    quotes = (F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit('"')))).cast("long")
    lines = stage(lines.withColumn("q", quotes), "lines")
    within = Window.partitionBy("path", "block").orderBy("k")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    parity = limited(_before(lines.groupBy("path", "block").agg(F.sum("q").alias("n")), "n").select("path", "block", "_before"))
    so_far = F.col("_before") + F.coalesce(F.sum("q").over(earlier), F.lit(0))
    begins = (so_far % 2 == 0).alias("begins")
    marked = lines.join(parity, ["path", "block"]).select("path", "block", "k", "line", "q", begins)
    blank = F.col("begins") & F.col("line").isin("", "\r")
    marked = stage(marked.where(~blank), "marked")
    starts = F.col("begins").cast("long")
    counts = limited(_before(marked.groupBy("path", "block").agg(F.sum(starts).alias("n")), "n").select("path", "block", "_before"))
    number = F.col("_before") + F.sum(starts).over(within.rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.join(counts, ["path", "block"]).select("path", number.alias("record"), "block", "k", "line", "q", "begins")
    numbered = stage(numbered, "numbered")
    alone = F.col("begins") & (F.col("q") % 2 == 0)  # a record on one line stays where it is
    parts = F.array_sort(F.collect_list(F.struct("block", "k", "line")))
    joined = numbered.where(~alone).groupBy("path", "record").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("raw"))
    raw = numbered.where(alone).select("path", "record", F.col("line").alias("raw")).unionByName(joined)

    def split(batches):
        for b in batches:
            fields, errors = [], []
            for text in b.column("raw").to_pylist():
                try:
                    (row,) = [r for r in csv.reader([text], strict=True) if r] if "\n" not in text else list(csv.reader(iter(text.splitlines(keepends=True)), strict=True))
                    fields.append(row)
                    errors.append(None)
                except (csv.Error, ValueError) as e:
                    fields.append(None)
                    errors.append(str(e) or "not a record")
            yield pa.record_batch({"path": b.column("path"), "record": b.column("record"), "fields": pa.array(fields, pa.list_(pa.string())), "error": pa.array(errors, pa.string())})

    read = stage(raw.mapInArrow(split, "path string, record long, fields array<string>, error string"), "records")
    heads = limited(read.where("record = 1").select("path", F.size("fields").alias("_n")))
    wrong = F.concat(F.lit("record has "), F.size("fields").cast("string"), F.lit(" fields, the header has "), F.col("_n").cast("string"))
    return read.join(heads, "path").select("path", "record", "fields", F.coalesce("error", F.when(F.size("fields") != F.col("_n"), wrong)).alias("error"))


def csv_chunks(spark: SparkSession, path: str, budget: int = 200) -> DataFrame:
    """``(path, chunk_index, chunk_text, token_count, chunk_type)``: each file's header, then its rows gathered up to ``budget`` tokens.

    As ``CsvParser`` has them for a file that one task can hold; records with an error are left out.
    """
    read = stage(csv_records(spark, path).where("error is null"), "fields")
    heads = limited(read.where("record = 1").select("path", F.col("fields").alias("_head")))
    cells = F.zip_with("_head", "fields", lambda h, c: F.concat(h, F.lit(": "), c))
    row = F.concat(F.lit("Row "), (F.col("record") - 1).cast("string"), F.lit(": "), F.array_join(cells, " | "), F.lit("\n"))
    rows = read.where("record > 1").join(heads, "path").select("path", "record", row.alias("row"))
    packed = pack_table(rows, "path", "record", "row", budget).select(F.col("table_id").alias("path"), (F.col("chunk_index") + 1).alias("chunk_index"), "chunk_text", "token_count", F.lit("csv_rows").alias("chunk_type"))
    head = F.concat(F.lit("CSV Document Headers: "), F.array_join("_head", " | "))
    first = heads.select("path", F.lit(0).alias("chunk_index"), head.alias("chunk_text")).withColumn("token_count", T.token_count(F.col("chunk_text"))).withColumn("chunk_type", F.lit("csv_header"))
    return first.unionByName(packed)
