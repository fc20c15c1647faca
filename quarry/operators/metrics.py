"""Counters, histograms and gauges, as ordinary aggregations over event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Upper bounds of the histogram buckets, by what is measured.
BUCKETS = {
    "http_seconds": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10],
    "search_seconds": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10],
    "search_results": [0, 1, 2, 5, 10, 20, 50, 100],
    "indexing_seconds": [0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120],
    "document_characters": [100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000],
    "chat_seconds": [0.5, 1, 2.5, 5, 10, 15, 30, 60, 120],
    "chat_sources": [0, 1, 2, 5, 10, 15, 20],
    "chat_response_characters": [100, 500, 1000, 2000, 5000, 10000, 20000],
    "query_optimization_seconds": [0.1, 0.25, 0.5, 1, 2.5, 5, 10],
}


def counter(rows: DataFrame, labels: Sequence[str], amount: str | None = None) -> DataFrame:
    total = F.count("*") if amount is None else F.sum(amount)
    return rows.groupBy(*labels).agg(total.alias("total"))


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """``(labels, le, cumulative, total, value_sum)``: rows at most each bound, in one pass over the input.

    ``only`` says which rows count in the buckets; ``le`` is null for all values.
    """
    v = F.col(value) if only is None else F.when(only, F.col(value))
    at = {f"_{i}": F.count(F.when(v <= F.lit(float(b)), 1)) for i, b in enumerate(bounds)}
    summed = rows.groupBy(*labels).agg(*[c.alias(k) for k, c in at.items()], F.count(v).alias("total"), F.sum(v).alias("value_sum"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("cumulative")))
    return summed.select(*labels, F.inline(F.array(*cells)), "total", "value_sum")


def latest(rows: DataFrame, labels: Sequence[str], value: str, at: str) -> DataFrame:
    """A gauge: the last value for each label."""
    return rows.groupBy(*labels).agg(F.max_by(value, at).alias("value"))


def token_totals(docs: DataFrame, text: str, labels: Sequence[str]) -> DataFrame:
    return docs.groupBy(*labels).agg(F.sum(T.token_count(F.col(text))).alias("tokens"), F.count("*").alias("documents"))


def token_usage(turns: DataFrame, text: str, labels: Sequence[str]) -> DataFrame:
    """Estimated model tokens by label."""
    return turns.groupBy(*labels).agg(F.sum(T.token_estimate(F.col(text))).alias("tokens"), F.count("*").alias("requests"))


def cache_hit_rate(requests: DataFrame, text: Column) -> DataFrame:
    """What a cache of processed texts without a bound would hold and hit."""
    each = requests.select(F.xxhash64(text).alias("h"), text.alias("t")).groupBy("h", "t").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("requests"), F.count("*").alias("entries"))
    rate = F.when(F.col("requests") > 0, (F.col("requests") - F.col("entries")) / F.col("requests")).otherwise(0.0)
    return total.select(F.coalesce("requests", F.lit(0)).alias("requests"), "entries", rate.alias("hit_rate"))
