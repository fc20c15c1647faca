"""Shards by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group that stays together. Groups are weighed in all three
dimensions against an equal share of a shard. A group over a ``1 / parcels`` part
of a shard in any dimension is placed by itself (there are at most three times
``shards * parcels`` such groups, since their parts sum to the whole); the others
are gathered into ``shards * parcels`` parcels by their hash. Only a group that is
too large for a shard is split, evenly into pieces of half a shard at most. Largest first, each unit
goes to the shard whose residual capacity has the highest dot product with the
unit's weights, then single moves even the bytes out. So the driver holds a table
whose size depends on the number of shards alone.

Slots number a shard's rows from 0: counts by (shard, bucket) give each bucket's
offset, rows are numbered within their bucket, and no task holds a whole shard.

Cases: a null text has no bytes, and null and empty texts are one group; rows
that repeat are rows of their own; a null id is placed like any other; an empty
table gives an empty result; a very long text is one row, so the shard that takes it
may exceed the others; ties go to the smaller shard and the smaller group hash; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.mixing import token_count
from quarry.session import stage


@dataclass(frozen=True)
class Settings:
    shards: int = 24
    parcels: int = 256
    pieces: int = 2  # to a shard, of a group that exceeds one
    overhead: int = 8  # bytes of a row besides its text
    bucket_rows: int = 20_000


DIMENSIONS = ("bytes", "tokens", "rows")


def facts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What placing needs of each row; ``row`` tells rows apart from then on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + settings.overhead).cast("long").alias("size"),
        token_count(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )


def greedy(weights: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each unit, largest first to the highest dot product with what is left (ties to the
    smaller number), and what is left then. ``weights`` are parts of one shard's share, a column for each dimension."""
    left = np.ones((shards, weights.shape[1]))
    out = np.empty(len(weights), dtype=np.int64)
    for i in np.argsort(-weights.max(axis=1), kind="stable"):
        s = int(np.argmax(np.round(left @ weights[i], 12)))  # equal ones must not differ by rounding
        out[i] = s
        left[s] -= weights[i]
    return out, left


def place(weights: np.ndarray, shards: int) -> np.ndarray:
    """``greedy``, then ``even_out``."""
    return even_out(weights, *greedy(weights, shards)) if len(weights) else np.empty(0, np.int64)


def even_out(weights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Move single units from the shard with the most bytes to that with the fewest while the gap narrows.

    Each move lowers the sum of squares of what is left, so it ends.
    """
    while True:
        high, low = int(np.argmin(left[:, 0])), int(np.argmax(left[:, 0]))
        gap = left[low, 0] - left[high, 0]
        own = np.flatnonzero((at == high) & (weights[:, 0] > 1e-12) & (weights[:, 0] < gap * (1 - 1e-9)))
        if not len(own):
            return at
        i = own[np.argmin(np.abs(weights[own, 0] - gap / 2))]
        at[i] = low
        left[high] += weights[i]
        left[low] -= weights[i]


def _sums() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]


def assign(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``rows`` of ``facts`` with their ``shard``."""
    s, spark = settings, rows.sparkSession
    total = rows.agg(*_sums()).first()
    share = [max(1.0, float(total[d] or 0)) / s.shards for d in DIMENSIONS]
    part = F.greatest(*[F.col(d) / F.lit(v) for d, v in zip(DIMENSIONS, share)])  # of a shard, in the largest dimension
    n_parcels = s.shards * s.parcels
    large = rows.groupBy("group").agg(*_sums()).withColumn("part", part).where(F.col("part") > 1 / s.parcels).select("group", "part").collect()
    table, base = [], n_parcels
    for r in sorted(large, key=lambda r: (-r.part, r.group)):
        pieces = int(np.ceil(r.part * s.pieces)) if r.part > 1 else 1
        table.append((r.group, base, pieces))
        base += pieces
    alone = F.broadcast(spark.createDataFrame(table, "_group long, _base long, _pieces long"))
    unit = F.coalesce(F.col("_base") + F.pmod(F.xxhash64("row"), F.col("_pieces")), F.pmod(F.col("group"), F.lit(n_parcels)))
    rows = rows.join(alone, F.col("group") == F.col("_group"), "left").withColumn("unit", unit).drop("_group", "_base", "_pieces")
    units = rows.groupBy("unit").agg(*_sums()).orderBy("unit").collect()
    weights = np.array([[u[d] / v for d, v in zip(DIMENSIONS, share)] for u in units]).reshape(-1, 3)
    shards = place(weights, s.shards)
    placed = F.broadcast(spark.createDataFrame([(u.unit, int(k)) for u, k in zip(units, shards)], "_unit long, shard int"))
    return rows.join(placed, F.col("unit") == F.col("_unit")).drop("_unit", "unit")


def slots(rows: DataFrame, n_rows: int, settings: Settings = Settings()) -> DataFrame:
    """Adds ``slot``, from 0 without gaps in each shard."""
    buckets = max(1, -(-n_rows // (settings.shards * settings.bucket_rows)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("row")))
    return numbered.join(offsets, ["shard", "_bucket"]).withColumn("slot", (F.col("_offset") + F.col("_k") - 1).cast("long")).drop("_bucket", "_k", "_offset")


def shard(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot, tokens)`` for every row of ``docs(doc_id, text)``."""
    rows = stage(facts(docs, settings), "facts")
    placed = stage(assign(rows, settings), "placed")
    return slots(placed, rows.count(), settings).select("doc_id", "size", "text_crc32", "shard", "slot", "tokens")
