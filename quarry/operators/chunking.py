"""Chunking of document tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.units import Chunk, Chunker, fields, tokens, trim
from quarry.session import small_batches, stage

CHUNK = "array<struct<chunk_index:int,chunk_text:string,start_pos:int,end_pos:int,token_count:int,chunk_type:string>>"
_ARROW = pa.list_(
    pa.struct([
        ("chunk_index", pa.int32()),
        ("chunk_text", pa.string()),
        ("start_pos", pa.int32()),
        ("end_pos", pa.int32()),
        ("token_count", pa.int32()),
        ("chunk_type", pa.string()),
    ])
)


def as_rows(chunks: list[Chunk], kind: str | None = None) -> list[dict]:
    return [
        {"chunk_index": i, "chunk_text": c.text, "start_pos": c.start, "end_pos": c.end_pos, "token_count": c.token_count, "chunk_type": kind or c.kind}
        for i, c in enumerate(chunks)
    ]


def chunks_of(text: Column, max_tokens: int = 256, overlap: int = 38, keep_short: bool = True) -> Column:
    """The chunks of a text as an array, by one Arrow pass; no shuffle.

    With ``keep_short`` a text within ``max_tokens`` is its own only chunk,
    untouched and of type ``text``. Null and blank texts have no chunks.
    """
    return _split(text, max_tokens, overlap, keep_short)["chunks"]


def _split(text: Column, max_tokens: int, overlap: int, keep_short: bool) -> Column:
    """``(tokens, chunks)`` of a text: how many tokens it has, and its chunks."""
    chunker = Chunker(max_tokens, overlap)

    def chunked(t: str | None, n: int) -> list[Chunk]:
        if keep_short and t and n <= max_tokens:
            return [Chunk(t, len(fields(t)), "text")] if trim(t) else []
        return chunker.chunk(t)

    @F.arrow_udf(f"struct<tokens:int,chunks:{CHUNK}>")
    def split(texts: pa.Array) -> pa.Array:
        found = texts.to_pylist()
        sizes = [tokens(t or "") for t in found]
        chunks = pa.array([as_rows(chunked(t, n)) for t, n in zip(found, sizes)], type=_ARROW)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), chunks], names=["tokens", "chunks"])

    return split(text)


def with_chunks(docs: DataFrame, text: str = "text", max_tokens: int = 256, overlap: int = 38) -> DataFrame:
    """``docs`` with ``tokens``, ``chunk_count`` and the ``chunks`` of each text as an array."""
    small_batches(docs.sparkSession)
    slim = docs.withColumn("_s", _split(F.col(text), max_tokens, overlap, True))
    return slim.select(*docs.columns, F.col("_s.tokens").alias("tokens"), F.size("_s.chunks").alias("chunk_count"), F.col("_s.chunks").alias("chunks"))


def chunk_rows(docs: DataFrame, id_: str = "id") -> DataFrame:
    """A row for each chunk of ``docs(id, chunks)``."""
    rows = docs.select(F.col(id_).alias("document_id"), F.explode("chunks").alias("c")).select("document_id", "c.*")
    return rows.select(T.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "*")


def chunk_documents(docs: DataFrame, text: str = "text", id_: str = "doc_id", max_tokens: int = 256, overlap: int = 38, keep_short: bool = True) -> DataFrame:
    """A row for each chunk of each document; see ``chunks_of``."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_).alias("document_id"), chunks_of(F.col(text), max_tokens, overlap, keep_short).alias("c"))
    # the outer form, since a filter for empty arrays would be put below and compute them twice
    rows = slim.select("document_id", F.explode_outer("c").alias("c")).where("c is not null").select("document_id", "c.*")
    return rows.select(T.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "*")


def word_windows(text: Column, max_tokens: int = 256, overlap: int = 38) -> Column:
    """Windows of words as ``array<struct<window, token_count, window_text>>``, in closed form and inside the JVM."""
    if overlap >= max_tokens:
        raise ValueError("overlap must be smaller than max_tokens")
    stride = max_tokens - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(F.lit(0), F.ceil((n - max_tokens) / F.lit(float(stride))).cast("int"))
        part = lambda i: F.slice(w, i * stride + 1, F.lit(max_tokens))
        every = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(i.alias("window"), F.size(part(i)).alias("token_count"), F.array_join(part(i), " ").alias("window_text")),
        )
        return F.when(n > 0, every).otherwise(F.array().cast("array<struct<window:int,token_count:int,window_text:string>>"))

    return T.let(T.fields(text), windows)


def packed_counts(text: Column, max_tokens: int = 256, overlap: int = 38) -> Column:
    """Token counts of the chunks that sentence units pack into, before any is split again; folds inside the JVM.

    The overlap before a unit depends on its place alone: of the running sums
    of token counts it is the last one within the budget that counts.
    """

    def fold(s: Column) -> Column:
        sizes = s["n"]

        def step(acc: Column, x: Column) -> Column:
            fits = (acc["cur"] == 0) | (acc["cur"] + x["n"] <= max_tokens)
            grown = F.struct((acc["cur"] + x["n"]).alias("cur"), acc["done"].alias("done"))
            opened = F.struct((x["ov"] + x["n"]).alias("cur"), F.concat(acc["done"], F.array(acc["cur"])).alias("done"))
            return F.when(fits, grown).otherwise(opened)

        def before(i: Column) -> Column:
            """Tokens of the longest run of units just before ``i`` within the overlap."""
            start = F.struct(F.lit(0).alias("t"), F.lit(False).alias("stop"))
            walk = lambda a, x: F.when(a["stop"] | (a["t"] >= overlap) | (a["t"] + x > overlap), F.struct(a["t"].alias("t"), F.lit(True).alias("stop"))).otherwise(
                F.struct((a["t"] + x).alias("t"), F.lit(False).alias("stop"))
            )
            # no unit is empty, so an overlap has at most as many units as tokens
            near = F.slice(sizes, F.greatest(i - overlap, F.lit(0)) + 1, F.least(i, F.lit(overlap)))
            return F.aggregate(F.reverse(near), start, walk, lambda a: a["t"])

        pairs = F.transform(sizes, lambda n, i: F.struct(n.alias("n"), before(i).alias("ov")))
        start = F.struct(F.lit(0).alias("cur"), F.array().cast("array<int>").alias("done"))
        return F.aggregate(pairs, start, step, lambda a: F.when(a["cur"] > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))

    units = F.transform(T.sentence_units(text), T.token_count)
    return T.let(F.struct(units.alias("n")), fold)


def _held_after(sizes: np.ndarray, states: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """What an open chunk holds after rows of ``sizes`` tokens, and how many were begun, for each of several beginnings.

    A state is 0 where no chunk is open, else one more than its tokens, of which all beyond the budget count alike.
    """
    states, begun = states.copy(), np.zeros(len(states), dtype=np.int64)
    for k, n in enumerate(sizes.tolist()):
        over = (states > 0) & (states - 1 + n > budget)
        begun += over
        states = np.minimum(np.where(over | (states == 0), n, states - 1 + n), budget + 1) + 1
        if (states == states[0]).all():  # from here on they can't differ
            held, more = int(states[0]) - 1, 0
            for m in sizes[k + 1 :].tolist():
                more, held = (more + 1, m) if held + m > budget else (more, held + m)
            return np.full(len(states), min(held, budget + 1) + 1), begun + more
    return states, begun


def pack_table(rows: DataFrame, table: str, order: str, text: str, budget: int) -> DataFrame:
    """Rendered rows of each ``table``, in ``order``, gathered into chunks of up to ``budget`` tokens: ``(table_id, chunk_index, chunk_text, token_count)``.

    A table may be far larger than a task: rows are dealt by ranges of (table, order). Where a table goes on from one range to
    the next, what its open chunk would hold at the end is worked out for everything that it may hold at the beginning (a
    number for each token of the budget); these, a row for each range, are chained on the driver, and then each range is packed
    from what it really begins with. Chunks that cross ranges are joined from their pieces.
    """
    spark = rows.sparkSession
    small_batches(spark)
    slim = rows.select(F.col(table).cast("string").alias("t"), F.col(text).alias("row"), F.col(order).cast("long").alias("o"))
    slim = slim.withColumn("n", F.coalesce(T.token_count(F.col("row")), F.lit(0)))
    placed = slim.repartitionByRange("t", "o").sortWithinPartitions("t", "o").withColumn("m", F.monotonically_increasing_id())
    placed = stage(placed.select("t", "row", "n", "m"), "rows")
    p = F.shiftright("m", 33).cast("int")
    ranges = int(placed.agg(F.max(p)).first()[0] or 0) + 1
    in_order = lambda df: df.repartitionById(ranges, p).sortWithinPartitions("m")
    every = np.arange(budget + 3)

    def segments(batches):
        """Runs ``(range, table, batch)`` of rows of one range and table."""
        for b in batches:
            own, of = b.column("t").to_pylist(), (b.column("m").to_numpy() >> 33).tolist()
            cuts = [0, *[k for k in range(1, len(own)) if own[k] != own[k - 1] or of[k] != of[k - 1]], len(own)]
            for k, e in zip(cuts, cuts[1:]):
                if k < e:
                    yield of[k], own[k], b.slice(k, e - k)

    def edges(batches):
        now = None
        for at, t, b in segments(batches):
            sizes = b.column("n").to_numpy()
            if now is None or now["p"] != at:
                if now is not None:
                    yield made(now)
                now = {"p": at, "first": t, "whole": True, "out": every, "begun": np.zeros(len(every), np.int64), "last": t}
            elif t != now["last"]:
                now |= {"whole": False, "last": t, "state": np.zeros(1, np.int64), "index": np.zeros(1, np.int64)}
            if now["whole"]:
                now["out"], more = _held_after(sizes, now["out"], budget)
                now["begun"] = now["begun"] + more
            else:
                now["state"], more = _held_after(sizes, now["state"], budget)
                now["index"] = now["index"] + more
        if now is not None:
            yield made(now)

    def made(e: dict) -> pa.RecordBatch:
        ends = (e["out"], e["begun"]) if e["whole"] else (e["state"], e["index"])
        row = {"p": e["p"], "first": e["first"], "last": e["last"], "whole": e["whole"], "state": ends[0].tolist(), "begun": ends[1].tolist()}
        kinds = (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.record_batch({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds)})

    found = in_order(placed.select("t", "n", "m")).mapInArrow(edges, "p int, first string, last string, whole boolean, state array<long>, begun array<long>")
    begins: dict[int, tuple[int, int]] = {}
    before, state, index = object(), 0, 0
    for e in found.orderBy("p").collect():  # a row for each range
        begins[e.p] = (state, index) if e["first"] == before else (0, 0)
        k = begins[e.p][0] if e.whole else 0
        state, index, before = e.state[k], e.begun[k] + (begins[e.p][1] if e.whole else 0), e["last"]

    def pack(batches):
        at, t, held, index, part, first, seam = None, None, 0, 0, [], 0, False
        out: list[tuple] = []

        def close(open_end: bool) -> None:
            if part:
                out.append((t, index, "".join(part), held, first, seam or open_end))

        for now, own, b in segments(batches):
            if now != at or own != t:
                close(now != at)
                s, index = begins[now] if now != at else (0, 0)
                at, t, part, held, seam = now, own, [], max(0, s - 1), s > 0
            for row, n, m in zip(b.column("row").to_pylist(), b.column("n").to_pylist(), b.column("m").to_pylist()):
                if (part or seam) and held + n > budget:
                    close(False)
                    index, held, part, seam = index + 1, 0, [], False
                if not part:
                    first = m
                part.append(row or "")
                held += n
            if len(out) >= 1000:
                yield from pieces(out)
                out = []
        close(True)
        yield from pieces(out)

    def pieces(out: list[tuple]):
        if out:
            kinds = {"table_id": pa.string(), "chunk_index": pa.int32(), "chunk_text": pa.string(), "held": pa.int64(), "m": pa.int64(), "seam": pa.bool_()}
            yield pa.record_batch({k: pa.array(v, kind) for (k, kind), v in zip(kinds.items(), zip(*out))})

    packed = stage(in_order(placed).mapInArrow(pack, "table_id string, chunk_index int, chunk_text string, held long, m long, seam boolean"), "packed")
    parts = F.array_sort(F.collect_list(F.struct("m", "chunk_text")))
    joined = packed.where("seam").groupBy("table_id", "chunk_index").agg(F.array_join(F.transform(parts, lambda x: x["chunk_text"]), "").alias("chunk_text"))
    whole = packed.where("not seam").select("table_id", "chunk_index", "chunk_text").unionByName(joined)
    return whole.withColumn("token_count", T.token_count(F.col("chunk_text")))
