"""Nearest vectors from part of a table, beside a scan of all of them."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.operators.vector_index import VectorIndex, _nearest

SCHEMA = "chunk_id long, document_id long, embedding array<float>"


def same(index, table, q, k):
    got = [(r.chunk_id, round(r.score, 9)) for r in index.search(q, k).collect()]
    want = [(r.chunk_id, round(r.score, 9)) for r in search.top_chunks(table, q, k).collect()]
    return got == want


def test_clusters_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    m = np.repeat(centres, 100, axis=0) + rng.normal(scale=0.05, size=(4000, 12))
    m[5] = m[6] = m[7]  # ties
    table = spark.createDataFrame([(i, i // 10, v.tolist()) for i, v in enumerate(m)], SCHEMA).repartition(3)
    index = VectorIndex(spark, str(tmp_path / "v")).build(table, 12)
    shares = []
    for q in (m[7], m[999] * 3, centres[17]):
        assert same(index, table, q.tolist(), 10)
        shares.append(index.read[0] / index.read[1])
    assert index.read[1] == 4000 and max(shares) < 0.1
    assert same(index, table, (-m[0]).tolist(), 10)


@pytest.mark.parametrize("pivots", [1, 7, None])
def test_random_and_odd_vectors(spark, tmp_path, pivots):
    rng = np.random.default_rng(4)
    rows = [(i, i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)))]
    rows += [(900, 1, None), (901, 1, [0.0] * 5), (902, 1, [1.0]), (903, 1, [float("nan")] * 5), (904, 1, []), (905, 1, rows[0][2])]
    table = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex(spark, str(tmp_path / "v")).build(table, 5, pivots)
    for q, k in ((rows[0][2], 3), (rows[9][2], 301), (rows[9][2], 1000), ([0.0, 0.0, 0.0, 0.0, 1.0], 10)):
        assert same(index, table.where(F.size("embedding") == 5), q, k)
    assert index.read[1] == 301
    assert index.search([0.0] * 5, 3).count() == 0


def test_memory_does_not_grow_with_pivots():
    """Products are held for a bounded number of vectors and pivots at a time, and give the same groups."""
    rng = np.random.default_rng(6)
    m, pivots = rng.normal(size=(8192, 16)), rng.normal(size=(2048, 16))
    tracemalloc.start()
    near, d = _nearest(m, pivots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    some = slice(0, 8192, 97)
    every = np.sqrt(np.square(m[some, None] - pivots[None]).sum(axis=2))
    assert (near[some] == every.argmin(axis=1)).all() and np.allclose(d[some], every.min(axis=1))


def test_empty(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v")).build(spark.createDataFrame([], SCHEMA), 5)
    assert index.search([1.0] * 5, 3).count() == 0 and index.read == (0, 0)
