"""Exact nearest vectors from part of a table: vectors in groups around pivots, and triangle inequalities to leave groups out.

Vectors, scaled to length 1, are grouped by their nearest pivot; pivots come from a bounded sample and decide only how
much is read, never the answer. A table holds them sorted by pivot and distance to it, another one each group's size and span of distances.
A search reads the groups nearest to the query until they hold enough, which bounds the distance of the last result; of the
other groups it reads those, and of each the span of distances, that the bound can't rule out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import cosine_to, limit_of
from quarry.session import small_batches

_SAMPLE = 20_000
_MOST_PIVOTS = 2048
_CELLS = 1 << 19  # products of vectors and pivots held at a time
_SLACK = 1e-6  # for rounding, on distances of at most 2


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vectors have a direction, and these scaled to length 1."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(-1).to_numpy(), -1)
    at = np.flatnonzero(sizes == dim)
    m = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], m[good] / norm[good, None]


def _nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot, and the distance to it."""
    near, d, half = np.zeros(len(m), np.int64), np.zeros(len(m)), 0.5 * np.einsum("ij,ij->i", pivots, pivots)
    step = max(1, _CELLS // max(1, pivots.size // pivots.shape[1], pivots.shape[1]))
    for k in range(0, len(m), step):
        part = m[k : k + step]
        near[k : k + step] = at = (part @ pivots.T - half).argmax(axis=1)
        d[k : k + step] = np.sqrt(np.square(part - pivots[at]).sum(axis=1))
    return near, d


class VectorIndex:
    """Groups of vectors under one folder; ``build`` makes them, ``search`` reads them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read = (0, 0)  # rows of the groups that the last search read, and of all groups

    def build(self, vectors: DataFrame, dim: int, pivots: int | None = None, seed: int = 5) -> VectorIndex:
        """Group ``vectors(chunk_id, document_id, embedding)``; those that are null, zero, not finite or of another length are left out."""
        small_batches(self.spark, rows=8192)
        n = vectors.count()
        k = min(_MOST_PIVOTS, pivots or max(1, int(n**0.5)))
        sample = vectors.select("embedding", F.xxhash64(F.lit(seed), "chunk_id").alias("_o")).orderBy("_o").limit(_SAMPLE).select("embedding")

        def found(batches):
            parts = [_units(b.column("embedding"), dim)[1] for b in batches]
            m = np.concatenate(parts) if parts else np.zeros((0, dim))
            del parts
            at = m[np.random.default_rng(seed).permutation(len(m))[:k]]
            for _ in range(4 if len(at) else 0):
                near, _d = _nearest(m, at)
                sums = np.zeros_like(at)
                np.add.at(sums, near, m)
                size = np.bincount(near, minlength=len(at))
                at = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], at)
            yield pa.record_batch({"pivot": pa.array(range(len(at)), pa.int32()), "at": pa.array(at.tolist(), pa.list_(pa.float64()))})

        places = sample.repartition(1).mapInArrow(found, "pivot int, at array<double>").orderBy("pivot").collect()  # at most ``_MOST_PIVOTS``
        centres = np.array([r["at"] for r in places]).reshape(-1, dim)
        told = self.spark.sparkContext.broadcast(centres)

        def grouped(batches):
            for b in batches:
                at, m = _units(b.column("embedding"), dim)
                if len(at) and len(told.value):
                    near, d = _nearest(m, told.value)
                    kept = b.take(pa.array(at))
                    yield pa.record_batch([pa.array(near, pa.int32()), pa.array(d), *kept.columns], names=["pivot", "d", *kept.schema.names])

        own = vectors.select("chunk_id", "document_id", F.col("embedding").cast("array<float>").alias("embedding"))
        kinds = {f.name: f.dataType.simpleString() for f in own.schema}
        rows = own.mapInArrow(grouped, "pivot int, d double, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
        rows.repartitionByRange("pivot", "d").sortWithinPartitions("pivot", "d").write.mode("overwrite").parquet(f"{self.path}/vectors")
        spans = self.spark.read.parquet(f"{self.path}/vectors").groupBy("pivot").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        named = self.spark.createDataFrame([(r["pivot"], r["at"]) for r in places], "pivot int, at array<double>")
        spans.join(named, "pivot").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/groups")
        return self

    def search(self, query: Sequence[float], limit: int | None = None, ties: Sequence[str] = ("chunk_id",)) -> DataFrame:
        """The ``limit`` chunks nearest to the query by cosine, with ``score``, as a scan of all vectors has them."""
        k, q = limit_of(limit), np.asarray(query, dtype=np.float64)
        length = float(np.sqrt((q * q).sum()))
        groups = self.spark.read.parquet(f"{self.path}/groups").orderBy("pivot").collect()  # a row for each pivot
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        self.read = (0, sum(g.n for g in groups))
        small_batches(self.spark, rows=8192)
        columns = ["chunk_id", "document_id", "score"]
        scored = lambda df: df.withColumn("score", cosine_to(F.col("embedding"), query)).where("score is not null").select(*columns)
        if not groups or not length > 0:
            return scored(rows).limit(0)
        to = np.sqrt(np.square(np.array([g["at"] for g in groups]) - q / length).sum(axis=1))
        least = np.maximum(0, np.maximum(to - np.array([g.hi for g in groups]), np.array([g.lo for g in groups]) - to))
        order = np.lexsort((to, least))
        held = np.cumsum([groups[i].n for i in order])
        first = order[: int(np.searchsorted(held, k)) + 1]
        near = scored(rows.where(F.col("pivot").isin([groups[i].pivot for i in first]))).orderBy(F.desc("score"), *ties).limit(k).collect()
        reach = float(np.sqrt(max(0.0, 2 - 2 * near[-1].score))) + _SLACK if len(near) == k else 2 + _SLACK
        wanted = [i for i in range(len(groups)) if least[i] <= reach]
        self.read = (sum(groups[i].n for i in {*wanted, *first}), self.read[1])
        spans = self.spark.createDataFrame([(groups[i].pivot, float(to[i] - reach), float(to[i] + reach)) for i in wanted], "pivot int, lo double, hi double")
        some = rows.where(F.col("pivot").isin([groups[i].pivot for i in wanted])) if len(wanted) < len(groups) else rows
        some = some.join(F.broadcast(spans), "pivot").where(F.col("d").between(F.col("lo"), F.col("hi")))
        return scored(some).orderBy(F.desc("score"), *ties).limit(k)
