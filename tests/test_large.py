"""Large CSV files by byte ranges, and packing by ranges of rows, beside the parser and the packing of one task."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quarry.catalogue import QUERIES
from quarry.operators.chunking import pack_table
from quarry.operators.units import pack_rows
from quarry.sources.files import CsvParser
from quarry.sources.large import csv_chunks, csv_records


def written(path, rows, end):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("end,size", [("\n", 61), ("\r\n", 190)])
def test_records_of_ranges(spark, tmp_path, end, size):
    """Quoted line ends at every offset to the ranges' edges."""
    rng = random.Random(size)
    cell = lambda: "".join(rng.choice(['a', 'é', '"', "\n", "\r\n", ",", " ", "word ", "\n\n"]) for _ in range(rng.randint(0, 12)))
    files = {}
    for name in ("one", "two"):
        rows = [["k", "some name", "v"], *[[f"{i}", cell(), cell()] for i in range(30)]]
        written(tmp_path / f"{name}.csv", rows, end)
        files[name] = (tmp_path / f"{name}.csv").read_bytes()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = csv_records(spark, str(tmp_path)).collect()
        chunks = csv_chunks(spark, str(tmp_path), 20).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parser = CsvParser()
    parser.budget = 20
    for name, data in files.items():
        own = sorted((r.record, r.fields, r.error) for r in got if f"/{name}.csv" in r.path)
        assert [f for _, f, _ in own] == parser.records(data) and {e for *_, e in own} == {None}
        assert [n for n, *_ in own] == list(range(1, len(own) + 1))
        made = sorted((r.chunk_index, r.chunk_text, r.token_count, r.chunk_type) for r in chunks if f"/{name}.csv" in r.path)
        assert made == [(i, c.text, c.token_count, c.kind) for i, (c, _) in enumerate(parser.chunks(data))]


def test_documents_are_written_by_all_tasks(spark, small, tmp_path):
    """No task holds the whole table: as many CSV files as the input has parts, with the same rows as one."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(map(tuple, QUERIES["csv_records"](spark, str(tmp_path)).collect()))
    files = spark.read.format("binaryFile").load(spark.sparkContext._quarry_made["csv", str(tmp_path)]).count()
    assert files == 3 and rows == sorted(map(tuple, QUERIES["csv_records"](spark, small).collect())) and len(rows) == docs.count()


def test_records_with_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n\n3\n"4"x,5\n6,7')
    got = sorted((r.record, r.fields, bool(r.error)) for r in csv_records(spark, str(tmp_path)).collect())
    assert got == [(1, ["a", "b"], False), (2, ["1", "2"], False), (3, ["3"], True), (4, None, True), (5, ["6", "7"], False)]


@pytest.mark.parametrize("budget,seed", [(5, 1), (40, 2)])
def test_packing_by_ranges(spark, budget, seed):
    """Tables over many ranges, long and empty rows, beside one pass."""
    rng = random.Random(seed)
    rows = [("hot", i) for i in range(900)] + [(t, i) for t in ("a", "b", "zz", "") for i in range(rng.randint(1, 60))]
    rows = [(t, i, "w " * rng.choice([0, 1, 1, 2, 3, 7, budget, budget + 1]) + f"\x0b{t}{i}\n") for t, i in rows]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "t string, o long, r string").orderBy(F.rand(1))
        got = pack_table(df, "t", "o", "r", budget).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = list(pack_rows(((t, r) for t, _, r in sorted(rows)), budget))
    assert sorted((r.table_id, r.chunk_index, r.chunk_text, r.token_count) for r in got) == sorted(want)


def test_packing_nothing(spark):
    assert pack_table(spark.createDataFrame([], "t string, o long, r string"), "t", "o", "r", 5).count() == 0
