"""Readable ids of numbers: one for each, and back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.ids import NUMBERS, number_of, numbered_id, readable_id


def test_one_for_each_of_ten_million(spark):
    ids = spark.range(10_000_000).select(numbered_id(F.col("id")).alias("i"))
    hashed = ids.select(F.xxhash64("i").alias("h")).agg(F.count_distinct("h").alias("n"), F.count("*").alias("all")).first()
    assert hashed.n == hashed["all"] == 10_000_000


@pytest.mark.parametrize("key", [0, 1, 99, 2**40 + 7])
def test_there_and_back(spark, key):
    numbers = [0, 1, 2, 255, 2**24 - 1, 2**24, 2**33, 2**47 + 12345, NUMBERS - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", numbered_id(F.col("n"), key).alias("i"))
    got = rows.select("n", "i", number_of(F.col("i"), key).alias("back"), F.col("i").rlike("^[a-z0-9-]+$").alias("ok"), F.length("i").alias("size")).collect()
    assert all(r.n == r.back and r.ok and r.size <= 30 and len(r.i.split("-")) == 4 for r in got)
    assert len({r.i for r in got}) == len(numbers)
    assert len(readable_id().split("-")) == 4


def test_odd_numbers(spark):
    row = spark.createDataFrame([(None,)], "n long").select(numbered_id(F.col("n")).alias("i"), number_of(F.lit("no-such-id-here")).alias("a"), number_of(F.lit("amber-nothing-000000-0000")).alias("b"), number_of(F.lit(None)).alias("c")).first()
    assert tuple(row) == (None, None, None, None)
    for n in (-1, NUMBERS):
        with pytest.raises(Exception, match="48 bits"):
            spark.createDataFrame([(n,)], "n long").select(numbered_id(F.col("n"))).collect()
