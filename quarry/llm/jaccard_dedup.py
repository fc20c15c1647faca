"""Near-duplicates by the exact Jaccard similarity of word shingles, joined through prefixes.

Sets: the distinct XXH64 hashes of each run of ``width`` A-Z lower-cased words
(``simhash_dedup.shingle_hashes``); fewer words make one shingle, no words an
empty set, which equals other empty ones. A set is known by the XXH64 of its
sorted hashes, so documents of the same shingles have collapsed before.

Links: two sets with a Jaccard similarity of at least ``least``, all of them
and no others (as far as 64-bit hashes tell shingles apart). Two such sets of
sizes n and m share at least ``least * n`` members, so in any one order of all
hashes their first ``n - ceil(least * n) + 1`` members, the prefixes, meet. They
meet in more: sharing ``need`` members in all, at least ``need - n + prefix`` of
them (or the same for m) lie in both prefixes, so pairs are counted by the cells
(prefix members) in which they meet, and few but true pairs are verified. Members
before the first that any other prefix holds bound what a set can share, which drops sets and pairs before.

The order is by hash, but hashes that recur within runs of neighbouring texts
come last (the most frequent ``_LAST`` of them, which are broadcast): shared
passages then seldom are in a prefix. Which ones are known changes the work and
never the result. What still crowds are large groups of near copies. These are
not paired off at once: members are first compared with a few hubs of their cell,
and only those that are not connected by then with one another. SimHash links
of the same shingles (``simhash_dedup.links``), verified likewise, are taken
before that, so that close copies are connected from the start. No round drops a pair.

Cases are those of ``simhash_dedup``: rows with a null ``doc_id`` take their
component from the others in it, and each row of the input has one here. A very
long text is hashed in runs; its set is held once, in one task.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.graphs import connected_components
from quarry.llm.labelled import give_back
from quarry.llm.simhash_dedup import fingerprint_of, links as simhash_links, shingle_hashes, text_key
from quarry.session import limited, small_batches, stage

_SEED = 42
_HUBS = 8
_ROUNDS = 3  # of hubs
_ASKED = 3  # cells of a set whose hubs it is compared with in a round
_LAST = 1 << 20  # recurring hashes put last, those of most sets; more only cost memory
_RUN = 1 << 20  # hashes among which recurring ones are sought at once


def members(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, width)).view(np.int64)


def name_of(items: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(items.tobytes(), _SEED)).astype(np.int64))


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))


def shingle_set(text: Column, width: int, spark) -> Column:
    """``(fp, items)`` of a text column: the set's name and its members."""
    small_batches(spark)

    @F.arrow_udf("struct<fp:bigint,items:array<bigint>>")
    def sets(texts: pa.Array) -> pa.Array:
        found = [members(t.as_py(), width) for t in texts]
        out = pa.StructArray.from_arrays([pa.array(list(map(name_of, found)), pa.int64()), _lists(found)], names=["fp", "items"])
        del found
        give_back()
        return out

    return sets.asNondeterministic()(text)  # else a pushed-down filter makes Spark hash each text twice


def signature(text: Column, width: int, least: Fraction, last: np.ndarray, spark) -> Column:
    """``(fp, n, print, prefix)`` of a text column: the set's name and size, its text's SimHash, and its first members, those in ``last`` (sorted) behind the others."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(last)

    @F.arrow_udf("struct<fp:bigint,n:int,print:bigint,prefix:array<bigint>>")
    def signed(texts: pa.Array) -> pa.Array:
        names, sizes, prints, found = [], [], [], []
        for t in texts:
            h = shingle_hashes(t.as_py(), width)
            s = np.unique(h).view(np.int64)
            n = len(s)
            names.append(name_of(s))
            sizes.append(n)
            prints.append(fingerprint_of(h))
            if len(held.value):
                late = held.value[np.minimum(np.searchsorted(held.value, s), len(held.value) - 1)] == s
                s = np.concatenate([s[~late], s[late]])
            found.append(s[: n + (-n * least.numerator) // least.denominator + 1].copy() if n else s)
        columns = [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), _lists(found)]
        out = pa.StructArray.from_arrays(columns, names=["fp", "n", "print", "prefix"])
        del found
        give_back()
        return out

    return signed.asNondeterministic()(text)


def recurring(texts: DataFrame, width: int, most: int = _LAST) -> np.ndarray:
    """The hashes that most sets share, sorted, as counted within runs of texts; at most ``most``."""

    def counted(batches):
        seen, run, size = set(), [], 0

        def found():
            h, k = np.unique(np.concatenate(run), return_counts=True)
            least = max(2, len(run) // 1000)
            return pa.RecordBatch.from_pydict({"h": h[k >= least], "k": k[k >= least].astype(np.int64)})

        for b in batches:
            for t in b.column(0):
                s = members(t.as_py(), width)
                name = name_of(s)
                if name not in seen:
                    seen.add(name)
                    run.append(s)
                    size += len(s)
                if size > _RUN:
                    yield found()
                    seen, run, size = set(), [], 0
        if run:
            yield found()
        del seen, run
        give_back()

    small_batches(texts.sparkSession)
    every = texts.mapInArrow(counted, "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
    return np.sort(every.orderBy(F.desc("k"), "h").limit(most).select("h").toArrow().column("h").to_numpy())


class Links:
    """The links between the distinct sets of ``docs(key, text)``; ``own(fp, n, prefix)`` are their prefixes, ``heads(fp, key)`` a text of each."""

    def __init__(self, docs: DataFrame, own: DataFrame, heads: DataFrame, width: int, least: Fraction, crowd: int):
        self.docs, self.own, self.heads, self.width, self.least, self.crowd = docs, own, heads, width, least, crowd
        self.a, self.b = least.as_integer_ratio()

    def _prefix(self, n: str) -> Column:
        return F.expr(f"cast({n} - ({self.a} * {n} + {self.b - 1}) div {self.b} + 1 as int)")

    def sets(self, fps: DataFrame) -> DataFrame:
        """``(fp, n, items)`` of the sets ``fps``, hashed anew from one text of each, as it takes less room than to keep those of all."""
        texts = self.docs.join(limited(stage(self.heads.join(fps, "fp", "left_semi").select("key"), "keys", self.met)), "key", "left_semi")
        every = texts.select(shingle_set(F.col("text"), self.width, self.docs.sparkSession).alias("s")).select("s.fp", F.size("s.items").alias("n"), "s.items")
        return stage(every.dropDuplicates(["fp"]), "sets", 16 * self.met)

    def _need(self, n, m) -> str:
        """SQL: the members that sets of sizes ``n`` and ``m`` must share."""
        return f"(({self.a} * ({n} + {m}) + {self.a + self.b - 1}) div {self.a + self.b})"

    def cells(self) -> DataFrame:
        """``(fp, n, u, cell, k)``: the members of prefixes that lie in ``k`` of them, more than one.

        ``u`` counts the members before the first that any other prefix holds. The first member that
        two similar sets share is in both prefixes, so a set of size n shares ``n - u`` at most. Rows
        go whose set could not be similar to any of the sizes that are in the cell.
        """
        total = self.own.agg(F.sum(F.size("prefix"))).first()[0] or 0
        every = self.own.select("fp", "n", F.posexplode("prefix").alias("i", "cell"))
        again = stage(every.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("cell"), "again", total)
        met = stage(every.join(again, "cell", "left_semi").distinct(), "met", total)
        total = self.met = met.count()  # of all tables from here on
        alone = met.groupBy("fp").agg(F.min("i").alias("u"))
        own = F.expr("cast(floor(16 * log2(n)) as int)")
        met = stage(met.drop("i").join(alone, "fp").withColumn("q", own), "alone", total)
        sizes = met.groupBy("cell", "q").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c"))
        sizes = sizes.groupBy("cell").agg(F.collect_list(F.struct("q", "lo", "hi", "c")).alias("sizes"))  # a few hundred at most
        least = f"(({self.a} * n + {self.b - 1}) div {self.b})"
        other = f"x.hi >= {least} and {self._need('n', f'greatest(x.lo, {least})')} <= n - u and (x.q <> q or x.c > 1)"
        met = met.join(sizes, "cell").where(F.expr(f"exists(sizes, x -> {other})")).select("fp", "n", "u", "cell")
        met = stage(met, "possible", total)
        return met.join(met.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1"), "cell")

    def _in_prefix(self) -> Column:
        """In how many cells a pair must meet."""
        return F.least(self._prefix("nu") - F.col("nu"), self._prefix("nv") - F.col("nv")) + F.expr(self._need("nu", "nv"))

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``(u, v)`` that meet in enough cells; ``eu`` and ``ev`` count the cells of either that are not looked at here."""
        counted = pairs.groupBy("u", "v", "nu", "nv", "eu", "ev").agg(F.count("*").alias("met"))
        return counted.where(F.col("met") + F.least("eu", "ev") >= self._in_prefix()).select("u", "v")

    def _rest(self, open_: DataFrame) -> DataFrame:
        """As ``_possible``, for open cells: a pair of two components comes out once, of the first cell that
        it shares, and only if it meets in enough of them (cells that are not open are of one component)."""
        lists = open_.groupBy("fp").agg(F.sort_array(F.collect_list("cell")).alias("own"))
        pairs = self._meeting(open_.join(lists, "fp"), "small", "root", "own").where("rootu <> rootv")
        shared = F.array_intersect("ownu", "ownv")
        enough = F.size(shared) + F.least("eu", "ev") >= self._in_prefix()
        return pairs.where(enough & (F.element_at(shared, 1) == F.col("cell"))).select("u", "v")

    def _sized(self, n: str, u: str, m: str, v: str) -> str:
        """SQL: sets of sizes ``n`` and ``m``, of which the first ``u`` and ``v`` members are shared with none, may be similar."""
        return f"{self.a} * greatest({n}, {m}) <= {self.b} * least({n}, {m}) and {self._need(n, m)} <= least({n} - {u}, {m} - {v})"

    def _meeting(self, cells: DataFrame, other: str, *keep: str) -> DataFrame:
        kept = {"fp": "", "n": "n", "u": "w", other: "e"} | {c: c for c in keep}
        side = lambda x: cells.select("cell", *[F.col(c).alias(name + x) for c, name in kept.items()])
        return side("u").join(side("v"), "cell").where("u < v").where(self._sized("nu", "wu", "nv", "wv"))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs(u, v)`` that are similar enough."""
        side = lambda x: sets.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"i{x}"))
        both = pairs.join(side("u"), "u").join(side("v"), "v")
        alike = F.size(F.array_intersect("iu", "iv")) * (self.a + self.b) >= self.a * (F.col("nu") + F.col("nv"))
        return stage(both.where(alike).select("u", "v"), "similar", self.met)

    def all(self, seeds: DataFrame) -> DataFrame:
        """``(u, v)``: links that connect the same sets as all links do; ``seeds(u, v)`` are looked at first."""
        met = stage(self.cells(), "shared", self.met)
        crowded = F.col("k") > self.crowd
        per = met.groupBy("fp").agg(F.count(F.when(crowded, 1)).alias("large"), F.count(F.when(~crowded, 1)).alias("small"))
        met = stage(met.join(per, "fp"), "cells", self.met)
        heavy = stage(met.where(crowded).select("cell", "fp", "n", "u", "small"), "heavy", self.met)
        pairs = stage(self._possible(self._meeting(met.where(~crowded), "large")).unionByName(seeds).distinct(), "pairs", 2 * self.met)
        asked = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).unionByName(heavy.select("fp")).distinct()
        sets = self.sets(stage(asked, "asked", self.met))
        links = self.verified(pairs, sets)
        if not heavy.head(1):
            return links
        for k in range(_ROUNDS):
            roots, open_ = self._open(heavy, links)
            if not open_.head(1):
                return links
            # half of them by chance, half those that have the fewest members of their own, which are close to most
            order = lambda j: F.struct(F.col("u") * (j % 2), F.xxhash64(F.lit(k * _HUBS + j), "fp"))  # noqa: B023, E731
            hubs = open_.groupBy("cell").agg(*[F.min_by("fp", order(j)).alias(f"h{j}") for j in range(_HUBS)])
            hubs = hubs.select("cell", F.explode(F.array_distinct(F.array(*[f"h{j}" for j in range(_HUBS)]))).alias("hub"))
            hubs = hubs.join(open_.select("cell", F.col("fp").alias("hub"), F.col("n").alias("nh"), F.col("u").alias("wh"), F.col("root").alias("rh")), ["cell", "hub"])
            # each set by a few of its cells, as those that share one mostly share more
            asking = open_.groupBy("fp", "n", "u", "root").agg(F.collect_list(F.struct(F.xxhash64(F.lit(k), "cell").alias("o"), "cell")).alias("c"))
            asking = asking.select("fp", "n", "u", "root", F.explode(F.slice(F.sort_array("c"), 1, _ASKED)["cell"]).alias("cell"))
            pairs = asking.join(hubs, "cell").where("root <> rh").where(self._sized("n", "u", "nh", "wh"))
            pairs = stage(pairs.select(F.least("fp", "hub").alias("u"), F.greatest("fp", "hub").alias("v")).distinct(), "hubs", self.met)
            # what is connected so far goes on as stars, which settle at once
            stars = roots.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v"))
            links = stage(stars.unionByName(self.verified(pairs, sets)), "links", self.met)
        _, open_ = self._open(heavy, links)
        return links.unionByName(self.verified(stage(self._rest(open_), "rest", self.met), sets))

    def _open(self, heavy: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The components so far, and the members of crowded cells that are not yet of one component, with their ``root``."""
        roots = stage(connected_components(links), "roots", self.met)
        tagged = stage(heavy.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "tagged", self.met)
        several = tagged.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("cell")
        return roots, stage(tagged.join(several, "cell", "left_semi"), "open", self.met)


def _seeds(heads: DataFrame, n: int) -> DataFrame:
    """Pairs ``(u, v)`` of sets whose SimHash is the same, or linked: each with the first of its fingerprint, and the first ones with one another."""
    hubs = stage(heads.groupBy("print").agg(F.min("fp").alias("hub"), F.count("*").alias("k")), "prints", n)
    same = heads.join(hubs.where("k > 1"), "print").where("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    near = simhash_links(hubs.select(F.col("print").alias("fp")))
    first = lambda x: hubs.select(F.col("print").alias(x), F.col("hub").alias("h" + x))
    linked = near.join(first("u"), "u").join(first("v"), "v").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
    return same.unionByName(linked)


def components(docs: DataFrame, width: int = 5, least: float = 0.8, crowd: int = 32, prints: bool = False) -> DataFrame:
    """``(doc_id, key, fp, root)`` for every row of ``docs(doc_id, text)``; ``key`` is ``text_key`` of its text.

    ``prints``: texts that ``simhash_dedup`` links by fingerprints of runs of ``width`` words are linked too, however similar their sets are.
    """
    spark, share = docs.sparkSession, Fraction(str(least))
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    last = recurring(docs.select("text"), width)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), signature(F.col("text"), width, share, last, spark).alias("s"))
    own = stage(own.select("doc_id", "key", "s.*"), "shingles")
    n = own.count()
    heads = stage(own.groupBy("fp").agg(F.min("key").alias("key"), F.min("print").alias("print")), "distinct", n)
    seeds = stage(_seeds(heads, n), "seeds", n)
    found = Links(texts, own.select("fp", "n", "prefix"), heads.select("fp", "key"), width, share, crowd).all(seeds)
    if prints:
        found = found.unionByName(seeds.select(*[F.col(c).cast("long").alias(c) for c in ("u", "v")]))
    roots = connected_components(found).select(F.col("node").alias("_fp"), "root")
    each = own.select("doc_id", "key", "fp").join(roots, F.col("fp") == F.col("_fp"), "left")
    return each.select("doc_id", "key", "fp", F.coalesce("root", "fp").alias("root"))
