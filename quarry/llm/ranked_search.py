"""Ranked lexical search by TPUT (three-phase uniform threshold) over postings dealt by term.

The postings of the asked items' terms are dealt by ranges of (term, impact), so that each term's list lies in order of
impact, a long one over several tasks. An impact is what one term adds to one document's score; it does not depend on the item.

1. The head of each list, ``top`` entries, gives every item documents with partial sums. Those of the best of them are
   looked up in the lists; the ``top``-th exact score is a lower bound.
2. The bound by the item's number of terms is a threshold for all its lists: a document below it in every list can't reach the
   bound. Each list sends what reaches the lowest threshold of the items that ask for its term, once for all of them, to where the
   document's entries meet; there each item sums what reaches its own threshold. With, for each list that sent
   nothing of a document, the most that it may hold below the threshold, these sums are upper bounds as well; documents that can't reach the
   lower bound end here, and the sums of the others raise it.
3. Documents whose upper bound reaches the raised bound are looked up in the lists, and ranked by their exact scores.

Bounds are compared so that equal scores stay, and nothing is cut off: results are those of scoring all documents.
Items are worked off in blocks of bounded numbers of terms, whose vocabulary and thresholds the workers get.

Cases: null and empty texts have no terms, and an item without terms, or whose terms no document holds, has no results; items that share an
id are one item with the terms of all; documents that share an id are ranked each for itself; equal scores go by id, null ids last, then by
row; an empty table of either kind gives an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from quarry.llm.labelled import give_back
from quarry.session import limited, small_batches, stage

BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IMPACT_BITS = 36  # an impact is below a million times a weight, and weights below 70,000


@dataclass(frozen=True)
class Settings:
    """``top`` documents an item; ``block_terms``: terms of the items that are worked off at once; ``tried``: documents of the
    heads, in multiples of ``top``, whose exact scores give an item's first bound."""

    top: int = 50
    block_terms: int = 300_000
    tried: int = 4


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each pair once."""
    low = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    terms = F.filter(F.split(low, BREAKS), lambda t: t != "")
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(row, doc_id, n, tid, tf)`` of the vocabulary's terms, ``tid`` being a term's place in it.

    And a row for each batch with ``tid`` -1: ``n`` documents that hold any term, with ``tf`` terms in all.
    """
    told = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def found(batches):
        for batch in batches:
            lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), BREAKS)
            seen = lists.flatten().dictionary_encode()
            at, doc = seen.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
            real = pc.not_equal(seen.dictionary, "").to_numpy(zero_copy_only=False)[at]
            n = np.bincount(doc[real], minlength=batch.num_rows)
            place = pc.fill_null(pc.index_in(seen.dictionary, value_set=told.value), -1).to_numpy().astype(np.int64)[at]
            hit = place >= 0
            keys, tf = np.unique(doc[hit].astype(np.int64) << 32 | place[hit], return_counts=True)
            owner = pa.array(keys >> 32)
            yield pa.record_batch({
                "row": pc.take(batch.column("row"), owner),
                "doc_id": pc.take(batch.column("doc_id"), owner),
                "n": pa.array(n[keys >> 32], pa.int64()),
                "tid": pa.array(keys & 0xFFFFFFFF, pa.int64()),
                "tf": pa.array(tf, pa.int64()),
            })
            whole = {"row": -1, "doc_id": None, "n": int((n > 0).sum()), "tid": -1, "tf": int(n.sum())}
            yield pa.record_batch({k: pa.array([v], pa.int64()) for k, v in whole.items()})
        give_back()

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return keyed.mapInArrow(found, "row long, doc_id long, n long, tid long, tf long")


def weighted(raw: DataFrame) -> DataFrame:
    """``(tid, impact, row)`` with impacts above 0, of staged ``postings``."""
    whole = raw.where("tid < 0").agg(F.sum("n"), F.sum("tf")).first()
    docs, terms = int(whole[0] or 0), int(whole[1] or 0)
    held = raw.where("tid >= 0")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weights = held.groupBy("tid").agg(F.count("*").alias("df")).select("tid", weight.alias("w"))
    by_term = held.join(limited(weights), "tid")
    m = f"(100 - 50 + ((50 * n * {docs}L) div {max(1, terms)}L))"
    impact = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {m}))")
    return by_term.select("tid", impact.alias("impact"), "row").where("impact > 0")


def _heads(lists: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each list; where a task's part of a list begins, that part's first, of which the best stay."""

    def first(batches):
        now, done = None, 0
        for batch in batches:
            tid = batch.column("tid").to_numpy()
            if not len(tid):
                continue
            starts = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
            within = np.arange(len(tid)) - np.repeat(starts, np.diff(np.append(starts, len(tid))))
            run = tid == tid[0]
            if tid[0] == now:  # the run goes on
                within[: int(run.argmin()) if not run.all() else len(tid)] += done
            now, done = tid[-1], int(within[-1]) + 1
            yield batch.filter(pa.array(within < top))

    own = lists.mapInArrow(first, lists.schema)
    order = Window.partitionBy("tid").orderBy(F.desc("impact"), "row")
    return own.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).drop("_k")


@dataclass
class _Asked:
    """The terms of a block's items, with each item's threshold and what a list may hold below it, by term and threshold."""

    items: np.ndarray
    keys: np.ndarray  # term and threshold in one number, ascending
    caps: np.ndarray
    bound: np.ndarray  # by item: the score to reach
    may: np.ndarray  # by item: the sum of its caps


def _sums(lists: DataFrame, asked: _Asked, n_terms: int) -> DataFrame:
    """``(item, row, s, seen)``: sums of what reaches the thresholds, and of the caps of their lists, where the bound is in reach."""
    least = np.full(n_terms, np.iinfo(np.int64).max)
    np.minimum.at(least, asked.keys >> _IMPACT_BITS, asked.keys & ((1 << _IMPACT_BITS) - 1))
    context = lists.sparkSession.sparkContext
    told, lowest = context.broadcast(asked), context.broadcast(least)

    def reaching(batches):
        for batch in batches:
            yield batch.filter(pa.array(batch.column("impact").to_numpy() >= lowest.value[batch.column("tid").to_numpy()]))

    def summed(tid, impact, row):
        own = told.value
        n, each = len(own.bound), max(1, 2_000_000 // len(own.bound))
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for k in range(0, len(starts), each):  # some documents at once, all items of each
            rows = starts[k : k + each]
            upto = starts[k + each] if k + each < len(starts) else len(row)
            t, i = tid[rows[0] : upto], impact[rows[0] : upto]
            local = np.repeat(np.arange(len(rows)), np.diff(np.append(rows, upto)))
            start = np.searchsorted(own.keys, t << _IMPACT_BITS, "left")
            size = np.searchsorted(own.keys, (t << _IMPACT_BITS) + i, "right") - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            pair = np.repeat(local, size) * n + own.items[at]
            s = np.bincount(pair, weights=np.repeat(i, size), minlength=len(rows) * n).astype(np.int64)  # far below 2**53
            seen = np.bincount(pair, weights=own.caps[at], minlength=len(rows) * n).astype(np.int64)
            of = np.arange(len(rows) * n) % n
            good = np.flatnonzero((s > 0) & (s + own.may[of] - seen >= own.bound[of]))
            if len(good):
                yield pa.record_batch({"item": pa.array(good % n, pa.int64()), "row": pa.array(row[rows[good // n]], pa.int64()), "s": pa.array(s[good]), "seen": pa.array(seen[good])})

    def met(batches):
        held: list[np.ndarray] = []  # the last document so far, which may go on
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("tid", "impact", "row")]
            new = [np.concatenate(x) for x in zip(held, new)] if held else new
            if len(new[2]):
                cut = int(np.searchsorted(new[2], new[2][-1]))
                held = [x[cut:] for x in new]
                if cut:
                    yield from summed(*(x[:cut] for x in new))
        if held and len(held[2]):
            yield from summed(*held)
        give_back()

    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = lists.mapInArrow(reaching, lists.schema).repartition(n, "row").sortWithinPartitions("row")
    return sent.mapInArrow(met, "item long, row long, s long, seen long")


def _exact(lists: DataFrame, likely: DataFrame, asked: DataFrame) -> DataFrame:
    """``(item, row, s)``: the exact scores of the pairs ``likely(item, row)``."""
    found = lists.join(limited(likely), "row").join(F.broadcast(asked), ["item", "tid"])
    return found.groupBy("item", "row").agg(F.sum("impact").alias("s"))


def _kth(sums: DataFrame, top: int, n_items: int) -> np.ndarray:
    """For each item the ``top``-th largest ``s``, 0 where there are fewer."""
    order = Window.partitionBy("item").orderBy(F.desc("s"))
    rows = sums.select("item", "s").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).where(F.col("_k") == top).collect()  # one for each item of the block
    out = np.zeros(n_items, dtype=np.int64)
    for r in rows:
        out[r.item] = r.s
    return out


def _block(docs: DataFrame, pairs: list, id_type: DataType, own: Settings) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` for the items of ``pairs(item_id, term)``."""
    spark, top = docs.sparkSession, own.top
    ids = list(dict.fromkeys(p.item_id for p in pairs))
    words = list(dict.fromkeys(p.term for p in pairs))
    item_at, word_at = {x: k for k, x in enumerate(ids)}, {x: k for k, x in enumerate(words)}
    item = np.array([item_at[p.item_id] for p in pairs], dtype=np.int64)
    tid = np.array([word_at[p.term] for p in pairs], dtype=np.int64)
    asked = spark.createDataFrame(pa.table({"item": item, "tid": tid}).to_pandas())
    raw = stage(postings(docs, words), "postings")
    dealt = weighted(raw)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lists = stage(dealt.repartitionByRange(n, F.col("tid"), F.desc("impact")).sortWithinPartitions("tid", F.desc("impact")), "lists")

    heads = stage(_heads(lists, top), "heads")
    most = np.zeros(len(words), dtype=np.int64)
    for r in heads.groupBy("tid").agg(F.max("impact").alias("m")).collect():  # one for each term of the block
        most[r.tid] = r.m
    first = heads.join(F.broadcast(asked), "tid").groupBy("item", "row").agg(F.sum("impact").alias("s"))
    best = Window.partitionBy("item").orderBy(F.desc("s"), "row")
    tried = first.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= own.tried * top).select("item", "row")
    bound = np.maximum(1, _kth(_exact(lists, stage(tried, "tried"), asked), top, len(ids)))
    lists_of = np.maximum(1, np.bincount(item[most[tid] > 0], minlength=len(ids)))  # those that hold anything
    least = np.maximum(1, -(-bound // lists_of))[item]
    cap = np.minimum(least - 1, most[tid])
    order = np.lexsort((least, tid))
    may = np.bincount(item, weights=cap, minlength=len(ids)).astype(np.int64)

    sums = stage(_sums(lists, _Asked(item[order], (tid[order] << _IMPACT_BITS) + least[order], cap[order], bound, may), len(words)), "sums")
    bound = np.maximum(bound, _kth(sums, top, len(ids)))
    bounds = spark.createDataFrame(pa.table({"item": np.arange(len(ids)), "bound": bound, "may": may}).to_pandas())
    likely = sums.join(F.broadcast(bounds), "item").where(F.col("s") + F.col("may") - F.col("seen") >= F.col("bound"))
    likely = stage(likely.select("item", "row"), "candidates")

    named = raw.where("tid >= 0").select("row", "doc_id").join(limited(likely.select("row").distinct()), "row", "left_semi").distinct()
    scored = _exact(lists, likely, asked).join(named, "row")
    order = Window.partitionBy("item").orderBy(F.desc("s"), F.asc_nulls_last("doc_id"), "row")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", LongType()), StructField("item_id", id_type)]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", F.col("s").alias("score"))


def search(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each item of ``items(item_id, text)`` the best of ``docs(doc_id, text)``."""
    own, spark = settings or Settings(), docs.sparkSession
    small_batches(spark, rows=4096, bytes_="8m")
    asked = stage(item_terms(items), "terms")
    blocks = max(1, -(-asked.count() // own.block_terms))
    at = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = []
    for k in range(blocks):
        pairs = asked.where(at == k).orderBy("item_id", "term").collect()  # about ``block_terms``
        if pairs:
            out.append(_block(docs, pairs, items.schema["item_id"].dataType, own))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


def oracle(top: int = 50) -> str:
    """DuckDB SQL for ``search`` over ``documents`` and ``benchmark``."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""with d as (select doc_id, {terms} as w from documents),
    size as (select doc_id, len(w) as n from d where len(w) > 0),
    whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from size),
    asked as (select distinct item_id, unnest({terms}) as term from benchmark),
    tf as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(w) as term from d) where term in (select term from asked) group by all),
    df as (select term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, whole group by term),
    impact as (select tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // terms)))) as s
      from tf join df using (term) join size using (doc_id), whole),
    scored as (select item_id, doc_id, sum(s)::bigint as score from asked join impact using (term) group by all having sum(s) > 0)
    select item_id, rank::int as rank, doc_id, score from (
      select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored) where rank <= {top}"""
