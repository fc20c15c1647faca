"""Approximate nearest neighbours by collision counting with query-aware hashing.

Largest inner products become smallest distances: the vectors of a block are
scaled by the largest norm there and get one more component that puts them on the
unit sphere, and queries are scaled to length 1 (a query's length changes no
order). Each of ``projections`` random lines has one sorted array of the vectors'
projections. A query centres a window on its own projection in each array; virtual
rehashing widens all windows together, by the factor ``widen``, and what newly
enters a window adds one to its vector's count, so each entry is counted once. A
vector is verified with its exact inner product, once, when its count reaches
``threshold`` of the windows. The search ends when as many as asked for are
verified within the windows' radius, or when the windows hold everything, which is exact.

Vectors and queries are dealt into blocks of a bounded size by hashes of their
rows; every pair of blocks is one task that builds the arrays of its block, and a
query's best of all blocks are merged. Every vector is indexed, and there is no
bound on the candidates that may be verified. What a search takes follows the data:
on clustered vectors about one in a hundred is verified, on near-random ones, whose
distances are nearly all alike, a third. Work and shuffle grow as queries times
vectors, divided by the block size (``Work`` counts them).

Cases: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, take no part, as vectors or as queries; vectors of different lengths
have no inner product, so each length is searched by itself; ties go to the smaller
id; of rows that share an id each is a vector and, if asked, a query of its own, to
which the others are candidates; other columns are not read; without vectors or
queries the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import ship, stage


@dataclass(frozen=True)
class Settings:
    k: int = 20
    projections: int = 64
    threshold: float = 0.62  # of the projections
    start: float = 0.85  # of the distance to the nearest of a few vectors
    widen: float = 1.08
    block: int = 16_384  # vectors of one sorted array
    query_block: int = 16_384  # queries of one task, at most
    run: int = 96  # queries that are worked off at once
    least_queries: int = 64  # and at least, where smaller blocks would only make more than ``tasks`` tasks
    tasks: int = 24
    seed: int = 5


@dataclass
class Work:
    """What searches took: pairs of a query and a vector in all, window entries counted, vectors verified."""

    pairs: int = 0
    entered: int = 0
    verified: int = 0


class Index:
    """The sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, s: Settings):
        self.s, self.ids, self.rows, self.vectors = s, ids, rows, vectors
        self.largest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()))
        scaled = vectors / self.largest
        rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", scaled, scaled), 0))
        self.points = np.hstack([scaled, rest[:, None]]).astype(np.float32)
        self.lines = np.random.default_rng(s.seed).standard_normal((self.points.shape[1], s.projections)).astype(np.float32)
        at = (self.points @ self.lines).T
        order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, order, axis=1)
        self.order = order.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)

    def windows(self, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's window begins and ends in each array."""
        lo = np.stack([np.searchsorted(x, c - radius, side="left") for x, c in zip(self.sorted, centre.T)], axis=1)
        hi = np.stack([np.searchsorted(x, c + radius, side="right") for x, c in zip(self.sorted, centre.T)], axis=1)
        return lo, hi

    def entered(self, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The vectors that a query's windows took in as they grew, each as often as windows did."""
        parts = [x[a:b] for x, a, b in zip(self.order, new[0].tolist(), old[0].tolist())]
        return np.concatenate(parts + [x[a:b] for x, a, b in zip(self.order, old[1].tolist(), new[1].tolist())])

    def search(self, qrows: np.ndarray, queries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], Work]:
        """For each query the places and inner products of its best, nearest first; and what that took.

        Queries are worked off in runs, so that what is kept of them (a count and a mark for each vector) does not grow with their number.
        """
        out, work = [], Work()
        for at in range(0, len(qrows), self.s.run):
            out += self._run(qrows[at : at + self.s.run], queries[at : at + self.s.run], work)
        return out, work

    def _best(self, places: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((self.rows[places], self.ids[places], -scores))[: self.s.k]
        return places[best], scores[best]

    def _run(self, qrows: np.ndarray, queries: np.ndarray, work: Work) -> list[tuple[np.ndarray, np.ndarray]]:
        s, n = self.s, len(self.ids)
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        unit = (queries / length[:, None]).astype(np.float32)
        centre = unit @ self.lines[:-1]
        step = max(1, n // 256)
        # the nearest of a few vectors tells from which radius on windows are worth counting
        close = unit @ self.points[::step, :-1].T
        close[qrows[:, None] == self.rows[None, ::step]] = -1  # not the query itself
        near = 2 - 2 * close.max(axis=1)
        radius = np.maximum(s.start * np.sqrt(np.maximum(near, 0)), 0.05)
        need = int(np.ceil(s.threshold * s.projections))
        start = self.windows(centre, np.zeros_like(radius))
        state: dict[int, list] = {}
        out: list[tuple[np.ndarray, np.ndarray]] = [None] * len(qrows)
        active = np.arange(len(qrows))
        while len(active):
            lo, hi = self.windows(centre[active], radius[active])
            going = []
            for q, a, b in zip(active.tolist(), lo, hi):
                count, done, at, places, scores = state.pop(q, None) or self._fresh(qrows[q], start[0][q], start[1][q], work)
                new = self.entered(at, (a, b))
                work.entered += len(new)
                count += np.bincount(new, minlength=n).astype(count.dtype)
                everything = int((b - a).min()) == n
                hit = np.flatnonzero(~done if everything else (count >= need) & ~done)
                done[hit] = True
                work.verified += len(hit)
                places = np.concatenate([places, hit])
                scores = np.concatenate([scores, np.einsum("ij,j->i", self.vectors[hit], queries[q])])
                if len(places) > 4 * s.k:  # of what is verified only the best can matter
                    places, scores = self._best(places, scores)
                # inner products that are this large are within the radius on the unit sphere
                least = (1 - radius[q] ** 2 / 2) * length[q] * self.largest
                if everything or np.count_nonzero(scores >= least) >= s.k:
                    out[q] = self._best(places, scores)
                else:
                    going.append(q)
                    state[q] = [count, done, (a, b), places, scores]
            active = np.array(going, dtype=np.int64)
            radius[active] *= s.widen
        work.pairs += len(qrows) * n
        return out

    def _fresh(self, row: int, lo: np.ndarray, hi: np.ndarray, work: Work) -> list:
        """Windows without width (what lies in them is counted), and nothing verified; the query's own row is never a candidate."""
        count = np.zeros(len(self.ids), np.uint16)
        own = self.entered((lo, lo), (lo, hi))
        if len(own):
            count += np.bincount(own, minlength=len(count)).astype(count.dtype)
        work.entered += len(own)
        return [count, self.rows == row, (lo, hi), np.empty(0, np.int64), np.empty(0)]


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def prepared(vectors: DataFrame, is_query: Column) -> DataFrame:
    """``(row, vec_id, v, d, q)`` of the rows that take part; ``row`` tells rows apart, ``d`` is the length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("d"), "q"), "vectors")


def _pairs(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame] | None:
    """Vectors and queries, each grouped by (length, pair of blocks); None where there are no queries."""
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    if not nq:
        return None
    blocks = -(-n // s.block)
    # few and large blocks of queries, since each is sent every vector; more only to keep some tasks busy
    query_blocks = max(-(-nq // s.query_block), min(-(-nq // s.least_queries), -(-s.tasks // blocks)))

    def deal(df: DataFrame, own: int, other: int, first: bool):
        mine = F.pmod(F.xxhash64("row", F.lit(s.seed)), F.lit(own))
        theirs = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        pair = df.select("row", "vec_id", "v", "d", mine.alias("m"), theirs.alias("t"))
        a, b = ("m", "t") if first else ("t", "m")
        return pair.select("d", (F.col(a) * F.lit(query_blocks) + F.col(b)).cast("long").alias("pair"), "row", "vec_id", "v").groupBy("d", "pair")

    return deal(rows, blocks, query_blocks, True), deal(rows.where("q"), query_blocks, blocks, False)


def search(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest of ``vectors(vec_id, embedding)`` to the rows where ``is_query``."""
    s, spark = settings, vectors.sparkSession
    ship(spark)
    pairs = _pairs(prepared(vectors, is_query), s)
    schema = "query_row long, query_id long, row long, vec_id long, score double"
    if pairs is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.split()[0]: [] for f in schema.split(", ")}
        if len(left) and len(right):
            index = Index(left.column("vec_id").to_numpy(), left.column("row").to_numpy(), _matrix(left.column("v")), s)
            qrows, qids = right.column("row").to_numpy(), right.column("vec_id").to_numpy()
            for row, q, (places, score) in zip(qrows, qids, index.search(qrows, _matrix(right.column("v")))[0]):
                for name, v in zip(out, (np.full(len(places), row), np.full(len(places), q), index.rows[places], index.ids[places], score)):
                    out[name].append(v)
        kinds = {k: pa.float64() if k == "score" else pa.int64() for k in out}
        return pa.table({k: pa.array(np.concatenate(v) if v else [], kinds[k]) for k, v in out.items()})

    found = pairs[0].cogroup(pairs[1]).applyInArrow(find, schema)
    # a query has at most k rows of each block; the best k of them are taken by a sort of structs
    far = F.struct((-F.col("score")).alias("far"), "vec_id", "row", "score")
    best = F.slice(F.array_sort(F.collect_list(far)), 1, s.k)
    top = found.groupBy("query_row", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("i", "b"))
    return top.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
