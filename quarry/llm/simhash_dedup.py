"""Near-duplicates by SimHash, joined through a segment-popcount embedding.

Fingerprints: A-Z lower-cased words of the whole text, three-word shingles
with repeats, XXH64 (seed 42) of each; a bit is 1 if it is set in over half of
the hashes. Fewer than three words make one shingle; no words make fingerprint
zero, which links like any other.

Links: two fingerprints that differ in at most ``MOST`` = 2 bits. A fingerprint
is mapped to the bit counts of its 16 four-bit segments. The Manhattan distance
of two such points never exceeds the Hamming distance, so linked fingerprints
lie at most 2 apart there, and some grid cell is within 1 of both. Every
distinct fingerprint is filed under its own cell and the 32 cells next to it;
those that meet in a cell are verified on their bits. A cell with more than
``crowd`` fingerprints is not paired off: its fingerprints are gridded again with
64 one-bit segments, where the lower bound is the Hamming distance itself, so
whatever meets within 1 of a cell is linked, and a star to the smallest member
stands for all pairs. Exact copies have collapsed before, nothing is capped, and
work grows in proportion to the number of distinct fingerprints.

Cases: a null text is an empty one; rows with a null ``doc_id`` get a
fingerprint and take their component from the others in it (null if none has an
id); repeated rows each get their row; an empty table gives an empty result; a
very long text is hashed in runs, whole; ties (several rows with the smallest id)
go to the smallest text hash; other columns are not read by
``near_duplicates`` and pass through ``representatives``, whatever their names
(but for those that begin with ``__simhash_``).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.graphs import connected_components
from quarry.session import limited, small_batches, stage

MOST = 2
_SEED = 42
_RUN = 1 << 16
_OWN = "__simhash_"  # begins the names of columns that stand beside the input's own


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of each run of ``width`` words, as unsigned 64-bit numbers."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, _SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    del words
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(ends) - width + 1]
    ends = ends[width - 1 :]
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _RUN):  # the shingles of a very long text are never all held at once
        spans = [line[a:b] for a, b in zip(starts[at : at + _RUN].tolist(), ends[at : at + _RUN].tolist())]
        out[at : at + len(spans)] = np.fromiter(map(xxh64_intdigest, spans, repeat(_SEED)), np.uint64, len(spans))
    return out


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit majority of ``hashes``, as a signed number; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, spark) -> Column:
    """The signed 64-bit fingerprint of a text column."""
    small_batches(spark)

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(shingle_hashes(t.as_py())) for t in texts], pa.int64())

    return prints.asNondeterministic()(text)  # else a pushed-down filter makes Spark hash each text twice


def text_key(text: Column) -> Column:
    """A hash by which rows of the same text are found again."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _count4(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, each in its own four bits of a long."""
    ones = F.lit(0x1111111111111111)
    bits = [F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _cells(prints: DataFrame) -> DataFrame:
    """(fp, cell): the own cell of each fingerprint and those that differ by one in one segment."""
    own = prints.select("fp", _count4(F.col("fp")).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("j"))
    one = F.expr("shiftleft(1L, 4 * ((j - 1) div 2))")
    digit = F.expr("shiftright(own, 4 * ((j - 1) div 2)) & 15")
    up = F.expr("j % 2 = 1")
    moved = F.when(F.col("j") == 0, F.col("own")).when(up & (digit < 4), F.col("own") + one).when(~up & (digit > 0), F.col("own") - one)
    return own.select("fp", moved.alias("cell")).where(F.col("cell").isNotNull())


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MOST


def links(prints: DataFrame, crowd: int = 16) -> DataFrame:
    """``(u, v)``: links between the distinct fingerprints ``fp``, or stars that connect the same ones."""
    rows = prints.count()
    cells = _cells(prints)
    met = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    met = stage(met, "cells", 33 * rows)
    twos = met.where("n = 2").where(_close(F.col("a"), F.col("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    few = met.where(f"n > 2 and n <= {crowd}").select("cell")
    lists = cells.join(few, "cell").groupBy("cell").agg(F.collect_list("fp").alias("fps"))
    pairs = lists.select("fps", F.explode("fps").alias("u")).select("u", F.explode("fps").alias("v"))
    pairs = pairs.where((F.col("u") < F.col("v")) & _close(F.col("u"), F.col("v")))
    crowded = cells.join(met.where(f"n > {crowd}").select("cell"), "cell").select("fp").distinct()
    bit = F.when(F.col("j") == 64, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(j as int))"))
    fine = crowded.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("j")).select("fp", F.col("fp").bitwiseXOR(bit).alias("cell"))
    hubs = fine.groupBy("cell").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("cell", "hub")
    stars = fine.join(hubs, "cell").where("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    return twos.unionByName(pairs).unionByName(stars).distinct()


def components(docs: DataFrame, crowd: int = 16) -> DataFrame:
    """``(doc_id, key, fp, root)`` for every row of ``docs(doc_id, text)``; ``root`` is a fingerprint that names the component."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), fingerprint(F.col("text"), docs.sparkSession).alias("fp"))
    own = stage(own, "prints")
    roots = connected_components(links(stage(own.select("fp").distinct(), "distinct", own.count()), crowd)).select(F.col("node").alias("_fp"), "root")
    return own.join(roots, F.col("fp") == F.col("_fp"), "left").select("doc_id", "key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, crowd: int = 16) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``."""
    found = stage(components(docs, crowd), "components")
    # members by fingerprint before by component, so that the copies of one text collapse first
    heads = found.groupBy("root", "fp").agg(F.min("doc_id").alias("least")).groupBy("root").agg(F.min("least").alias("component_id"))
    heads = stage(heads, "heads", found.count())  # so that the join is alone in its stage, where a hot component can be split
    return found.join(heads, "root").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, width: int = 3, similar: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one left of each component: that with the smallest id (rows without an id come last).

    Components are those of ``components``. With ``similar`` they are those of
    ``jaccard_dedup.components``: texts are linked by fingerprints of ``width`` words,
    and all texts too whose shingles have at least that Jaccard similarity, since
    fingerprints of such texts may lie further apart than any radius that a grid could
    serve (and those of texts that repeat a passage nearer than their sets). Of rows that share
    id and text one stays; of rows that share an id alone each stands for its own
    component. Other columns stay as they are.
    """
    from quarry.llm import jaccard_dedup

    if similar is None and width != 3:
        raise ValueError("fingerprint links are those of three words")
    found = stage(components(docs) if similar is None else jaccard_dedup.components(docs, width, similar, prints=True), "components")
    # by fingerprint (or set) first: a component may hold a third of all rows, but few different texts
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    heads = found.groupBy("root", "fp").agg(F.min(order).alias("o")).groupBy("root").agg(F.min("o").alias("o"))
    heads = heads.select(F.col("o.b").alias("_id"), F.col("o.c").alias("_key"))
    rows = found.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    # a text may not be in two components, so id and text tell a head
    marked = rows.join(heads, rows.doc_id.eqNullSafe(heads._id) & (rows.key == heads._key), "left")
    is_head = F.col("_key").isNotNull()
    marked = stage(marked.select("doc_id", "key", (~is_head).alias("out"), (is_head & (F.col("n") > 1)).alias("again")).where("out or again"), "dropped", found.count())
    own = {c: _OWN + c for c in ("doc_id", "key")}
    gone, again = (limited(marked.where(c).select(*[F.col(c).alias(v) for c, v in own.items()])) for c in ("true", "again"))
    docs_ = docs.withColumn(_OWN + "of", text_key(F.col("text")))
    on = lambda t: docs_["doc_id"].cast("long").eqNullSafe(t[own["doc_id"]]) & (docs_[_OWN + "of"] == t[own["key"]])
    kept = docs_.join(gone, on(gone), "left_anti")
    if again.head(1):
        kept = kept.unionByName(docs_.join(again, on(again), "left_semi").dropDuplicates(["doc_id", _OWN + "of"]))
    return kept.drop(_OWN + "of")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
