"""Collocations: frequent words as dense ids, n-grams of ids as fixed-width keys, counted by sorting.

Per language, words are counted first; those that are frequent enough get ids in
the byte order of the words. Texts then become runs of ids that break at
punctuation and at every rarer word, for no frequent phrase spans one. Each run's
n-grams of two to four ids are packed into keys of four fields of the same width,
sorted by 16-bit digits, and equal neighbours counted, first within a batch of
texts. Blocks of counted keys are dealt by ranges of keys (cut at equal shares of
what the word counts let expect), each range is sorted and counted again, and
what is frequent comes out: no key is ever a row before it is.

Memory: a task holds one batch of texts, or one range's blocks; a key lies in one
block at most once for each batch, so a phrase that fills the corpus is a number
a batch. The dictionary is sent to the workers where it has at most
``sent_words`` entries (it is counted); a larger one is joined to each text's own distinct words.

Cases: null and empty texts have no words; a null language is ``und``; repeated rows
count as often as they are there; equal scores and counts are ranked by the phrase's UTF-8 bytes; an empty table
gives an empty result; very long texts are read whole, alone in their batch; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.labelled import give_back
from quarry.session import limited, small_batches, stage

MARKS = r"[.,;:!?\x0A-\x0D]+"
GAPS = r"[\x20\x09]+"
_BREAK = "\n"  # no word holds it
_STEP = 1 << 20  # places of a batch whose n-grams are sorted at once
_IDS = ("i1", "i2", "i3", "i4")


@dataclass(frozen=True)
class Settings:
    """Phrases of 2 to 4 words found ``least`` times; dropped where a longer one that holds them is at least
    ``covered`` percent as frequent; the first ``top`` of each language."""

    least: int = 30
    covered: int = 80
    top: int = 2000
    sent_words: int = 2_000_000
    range_keys: int = 1_500_000


def tokens(texts: pa.Array) -> pa.ListArray:
    """Each text's words, A-Z lower-cased, with a break token between pieces and at the end; empty tokens may be among them."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    ended = pc.binary_join_element_wise(low, _BREAK, "")
    return pc.split_pattern_regex(pc.replace_substring_regex(ended, MARKS, f" {_BREAK} "), GAPS)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    langs = pc.dictionary_encode(batch.column("lang"))
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.filter(pc.equal(langs.indices, k))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)``: all words of ``docs(lang, text)``, counted in each batch before they are dealt by word."""

    def counted(batches):
        for batch in batches:
            for lang, part in _by_lang(batch):
                seen = tokens(part.column("text")).flatten().dictionary_encode()
                n = np.bincount(seen.indices.to_numpy(), minlength=len(seen.dictionary))
                found = pa.record_batch({"lang": pa.array([lang] * len(n), pa.string()), "word": seen.dictionary, "n": pa.array(n, pa.int64())})
                yield found.filter(pc.invert(pc.is_in(found.column("word"), pa.array(["", _BREAK]))))
        give_back()

    return docs.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """``(lang, word, f, id)`` of the frequent words: dense ids from 1 in the order of language, then of the word's bytes."""
    spark = words.sparkSession
    frequent = words.where(F.col("f") >= least)
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-frequent.count() // 100_000)))
    placed = stage(frequent.repartitionByRange(n, "lang", "word").sortWithinPartitions("lang", "word").withColumn("_m", F.monotonically_increasing_id()), "dictionary")
    part, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "p long, b long")
    return placed.join(F.broadcast(starts), part == F.col("p")).select("lang", "word", "f", (F.col("b") + within + 1).alias("id"))


def radix_order(hi: np.ndarray, lo: np.ndarray, bits: int) -> np.ndarray:
    """The order of 128-bit keys, of which ``bits`` are in use, by digits of 16 bits from the lowest."""
    order = np.arange(len(lo))
    for s in range(0, bits, 16):
        digit = (((hi if s >= 64 else lo) >> np.uint64(s % 64)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def counted_runs(hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sum of ``n`` (or the number) of each."""
    order = radix_order(hi, lo, bits)
    hi, lo = hi[order], lo[order]
    first = np.ones(len(lo), dtype=bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    at = np.flatnonzero(first)
    total = np.diff(np.append(at, len(lo))) if n is None else (np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64))
    return hi[at], lo[at], total.astype(np.int64)


def _shifted(ids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit ``ids << s`` as a high and a low half."""
    ids = ids.astype(np.uint64)
    zero = np.zeros_like(ids)
    if s >= 64:
        return ids << np.uint64(s - 64), zero
    return (ids >> np.uint64(64 - s) if s else zero), ids << np.uint64(s)


def pack(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Four fields of ``width`` bits from the highest; missing ids are 0."""
    hi = lo = np.uint64(0)
    for k, x in enumerate(ids):
        a, b = _shifted(x, width * (3 - k))
        hi, lo = hi | a, lo | b
    return hi, lo


def unpack(hi: np.ndarray, lo: np.ndarray, width: int) -> list[np.ndarray]:
    mask = np.uint64((1 << width) - 1)
    out = []
    for k in range(4):
        s = width * (3 - k)
        if s >= 64:
            v = hi >> np.uint64(s - 64)
        elif s + width <= 64:
            v = lo >> np.uint64(s)
        else:
            v = (lo >> np.uint64(s)) | (hi << np.uint64(64 - s))
        out.append((v & mask).astype(np.int64))
    return out


def grams(ids: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the runs of two to four ids of an array in which 0 breaks."""
    for at in range(0, len(ids), _STEP):
        part = ids[at : at + _STEP + 3]
        good = part != 0
        last = min(_STEP, len(ids) - at)
        for n in (2, 3, 4):
            m = min(last, len(part) - n + 1)
            if m <= 0:
                continue
            whole = good[:m].copy()
            for k in range(1, n):
                whole &= good[k : k + m]
            p = np.flatnonzero(whole)
            yield pack([part[p + k] for k in range(n)], width)


def _to_block(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and counts, byte by byte in planes, so that what neighbours share compresses."""
    planes = np.stack([x.astype("<u8") for x in (hi, lo, n)]).view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)
    raw = planes.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _from_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(pa.decompress(block[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    planes = np.ascontiguousarray(raw.reshape(3, 8, -1).transpose(0, 2, 1)).view("<u8").reshape(3, -1)
    return planes[0].astype(np.uint64), planes[1].astype(np.uint64), planes[2].astype(np.int64)


def key_ranges(known: DataFrame, width: int, total: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends, after the first, of ranges of keys that should hold about ``each`` of ``total`` n-grams.

    From word counts: a range's end is a first word and, within it, a second one. Where the dictionary is large, one
    word in so many stands for the others between it and the next, but for those that alone fill a quarter range.
    Only how evenly the work is dealt depends on it.
    """
    n_ranges = max(1, -(-total // each))
    if n_ranges == 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    every = max(1, known.count() // 200_000)
    heavy = F.col("f") > max(1, total // (4 * n_ranges))
    kept = known.where(heavy | (F.col("id") % every == 0)).select("lang", "id", F.when(heavy, F.col("f")).otherwise(F.col("f") * every).alias("f"))
    rows = kept.orderBy("id").toPandas()  # at most 200,000 and four for each range
    ids, f = rows["id"].to_numpy(), rows["f"].to_numpy(dtype=np.float64)
    ends = np.cumsum(f)
    lang = rows["lang"].to_numpy()
    first = np.searchsorted(ends, ends[-1] * np.arange(1, n_ranges) / n_ranges)
    first = np.minimum(first, len(ids) - 1)
    share = (ends[-1] * np.arange(1, n_ranges) / n_ranges - (ends[first] - f[first])) / np.maximum(f[first], 1)
    second = np.zeros(len(first), dtype=np.int64)
    bounds = {x: (np.flatnonzero(lang == x)[0], np.flatnonzero(lang == x)[-1]) for x in set(lang[first])} if len(first) else {}
    for j, at in enumerate(first):
        a, b = bounds[lang[at]]
        base = ends[a] - f[a]
        second[j] = ids[min(b, a + int(np.searchsorted(ends[a : b + 1], base + share[j] * (ends[b] - base))))]
    return pack([ids[first], second], width)


def _place(hi: np.ndarray, lo: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each lower end, the place in sorted keys where its range begins."""
    out = np.empty(len(ends[0]), dtype=np.int64)
    for j, (h, x) in enumerate(zip(*ends)):
        a, b = np.searchsorted(hi, h, "left"), np.searchsorted(hi, h, "right")
        out[j] = a + np.searchsorted(lo[a:b], x, "left")
    return out


def count_grams(runs: DataFrame, encode, width: int, ends: tuple[np.ndarray, np.ndarray], least: int) -> DataFrame:
    """``(i1, i2, i3, i4, a)``: n-grams of ids found ``least`` times; ``encode`` turns a batch of ``runs`` into arrays of ids."""
    bits, n_ranges = 4 * width, len(ends[0]) + 1

    def blocks(batches):
        for batch in batches:
            for ids in encode(batch):
                parts = [counted_runs(hi, lo, None, bits) for hi, lo in grams(ids, width)]
                if not parts:
                    continue
                hi, lo, n = (np.concatenate(x) for x in zip(*parts))
                if len(parts) > 3:  # more than one step: the same keys may come again
                    hi, lo, n = counted_runs(hi, lo, n, bits)
                else:
                    order = radix_order(hi, lo, bits)
                    hi, lo, n = hi[order], lo[order], n[order]
                cut = np.concatenate([[0], _place(hi, lo, ends), [len(hi)]])
                at = [r for r in range(n_ranges) if cut[r] < cut[r + 1]]
                yield pa.record_batch({"r": pa.array(at, pa.int64()), "block": pa.array([_to_block(hi[cut[r] : cut[r + 1]], lo[cut[r] : cut[r + 1]], n[cut[r] : cut[r + 1]]) for r in at], pa.binary())})
        give_back()

    def frequent(parts):
        hi, lo, n = counted_runs(*(np.concatenate(x) for x in zip(*parts)), bits)
        good = n >= least
        cols = unpack(hi[good], lo[good], width)
        return pa.record_batch(dict(zip(_IDS, (pa.array(c, pa.int64()) for c in cols))) | {"a": pa.array(n[good], pa.int64())})

    def reduced(batches):
        now, parts, held = None, [], 0
        for batch in batches:
            for r, block in zip(batch.column("r").to_pylist(), batch.column("block")):
                if r != now and parts:
                    yield frequent(parts)
                    parts, held = [], 0
                now = r
                parts.append(_from_block(block.as_buffer()))
                held += len(parts[-1][0])
                if len(parts) > 1 and held > 3_000_000:  # what came in many blocks is summed before more of it comes
                    parts = [counted_runs(*(np.concatenate(x) for x in zip(*parts)), bits)]
                    held = min(held // 2, len(parts[0][0]))
        if parts:
            yield frequent(parts)
        give_back()

    partitions = max(1, min(n_ranges, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = runs.mapInArrow(blocks, "r long, block binary").repartitionById(partitions, F.expr(f"cast(r * {partitions} div {n_ranges} as int)"))
    return dealt.sortWithinPartitions("r").mapInArrow(reduced, ", ".join(f"{c} long" for c in (*_IDS, "a")))


def _sent(known: DataFrame):
    """An encoder that knows the whole dictionary."""
    words: dict[str, tuple[pa.Array, int]] = {}
    rows = known.orderBy("id").select("lang", "word", "id").toArrow().combine_chunks()  # bounded by ``sent_words``
    if rows.num_rows:
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            at = np.flatnonzero(langs.indices.to_numpy() == k)
            part = rows.slice(int(at[0]), len(at))  # a language's ids follow each other
            words[lang] = (part.column("word").combine_chunks(), int(part.column("id")[0].as_py()))
    told = known.sparkSession.sparkContext.broadcast(words)

    def encode(batch):
        for lang, part in _by_lang(batch):
            own = told.value.get(lang)
            if own is None:
                continue
            seen = tokens(part.column("text")).flatten().dictionary_encode()
            place = pc.index_in(seen.dictionary, value_set=own[0])
            ids = np.where(place.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(place, 0).to_numpy().astype(np.int64) + own[1], 0)
            keep = np.array(pc.not_equal(seen.dictionary, "").to_numpy(zero_copy_only=False))
            at = seen.indices.to_numpy()
            yield ids[at[keep[at]]]

    return encode


def _with_own_words(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, object]:
    """For a large dictionary: each text with the ids of its own distinct words, and an encoder for these."""
    keyed = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def distinct(batches):
        for batch in batches:
            for lang, part in _by_lang(batch):
                lists = tokens(part.column("text"))
                rows = pc.take(part.column("_row"), pc.list_parent_indices(lists))
                own = pa.table({"_row": rows, "word": lists.flatten()}).group_by(["_row", "word"]).aggregate([])
                for b in own.append_column("lang", pa.array([lang] * len(own), pa.string())).select(["_row", "lang", "word"]).combine_chunks().to_batches(max_chunksize=10_000):
                    yield b

    pairs = keyed.mapInArrow(distinct, "_row long, lang string, word string").join(known.select("lang", "word", "id"), ["lang", "word"])
    owned = pairs.groupBy("_row").agg(F.collect_list(F.struct("word", "id")).alias("_own"))  # a text's own distinct words

    def encode(batch):
        for row in range(batch.num_rows):
            part = batch.slice(row, 1)
            own = part.column("_own").flatten()
            seen = tokens(part.column("text")).flatten().dictionary_encode()
            place = pc.index_in(seen.dictionary, value_set=own.field("word"))
            known_ids = own.field("id").to_numpy()
            ids = np.array([0 if p is None else known_ids[p] for p in place.to_pylist()], dtype=np.int64)
            keep = np.array(pc.not_equal(seen.dictionary, "").to_numpy(zero_copy_only=False))
            at = seen.indices.to_numpy()
            yield ids[at[keep[at]]]

    return keyed.join(owned, "_row").select("text", "_own"), encode


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _key(*ids: Column) -> list[Column]:
    out = [*ids, *[F.lit(0).cast("long")] * (4 - len(ids))]
    return [c.alias(n) for c, n in zip(out, _IDS)]


def mine(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of ``docs(lang, text)``: each language's best phrases, ranked.

    A phrase's score is that of its weakest cut in two: two millionths of its count by the sum of its parts' counts.
    """
    own, spark = settings or Settings(), docs.sparkSession
    small_batches(spark, rows=4096, bytes_="8m")
    texts = _rows(docs)
    words = stage(count_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = stage(dictionary(words, own.least), "ids")
    size, total = known.count(), int(words.agg(F.sum("f")).first()[0] or 0)
    width = max(1, int(size).bit_length())
    ends = key_ranges(known, width, 3 * total, own.range_keys)
    if size <= own.sent_words:
        runs, encode = texts, _sent(known)
    else:
        runs, encode = _with_own_words(texts, known)
    found = stage(count_grams(runs, encode, width, ends, own.least), "grams")

    ids = [F.col(c) for c in _IDS]
    n = 2 + (ids[2] > 0).cast("int") + (ids[3] > 0).cast("int")
    counts = limited(found.unionByName(known.select(*_key(F.col("id")), F.col("f").alias("a"))))
    # every cut of a candidate in two, with both parts' counts; both are frequent, so inner joins find them
    left = [F.array(*[F.when(F.lit(j) < k, ids[j]).otherwise(F.lit(0)) for j in range(4)]) for k in (1, 2, 3)]
    right = [F.array(*[*ids[k:], *[F.lit(0).cast("long")] * k]) for k in (1, 2, 3)]
    cut = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), left[k - 1].alias("x"), right[k - 1].alias("y"), n.alias("n")) for k in (1, 2, 3)]), lambda c: c.k < c.n))
    cuts = found.select(*_IDS, "a", cut.alias("c"))
    part = lambda side, name: counts.select(*[F.col(c).alias(f"{side}{c}") for c in _IDS], F.col("a").alias(name))
    on = lambda side: [F.col(f"c.{side}")[j] == F.col(f"{side}{c}") for j, c in enumerate(_IDS)]
    cuts = cuts.join(part("x", "l"), on("x")).join(part("y", "r"), on("y"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.withColumn("s", score).groupBy(*_IDS, "a").agg(F.min(F.struct("s", F.col("c.k").alias("k"), "l", "r")).alias("w"))
    # what a longer candidate covers
    inner = [[F.array(*[*ids[p : p + m], *[F.lit(0).cast("long")] * (4 - m)]) for p in range(3 - m)] for m in (2,)][0]
    of_three = F.array(*inner, F.array(ids[1], ids[2], F.lit(0).cast("long"), F.lit(0).cast("long")))
    of_four = F.array(*[F.array(*[*ids[p : p + m], *[F.lit(0).cast("long")] * (4 - m)]) for m in (2, 3) for p in range(5 - m)])
    longer = found.where("i3 > 0").select("a", F.explode(F.when(ids[3] > 0, of_four).otherwise(of_three)).alias("v"))
    covers = longer.groupBy(*[F.col("v")[j].alias(c) for j, c in enumerate(_IDS)]).agg(F.max("a").alias("most"))
    kept = weakest.join(covers, list(_IDS), "left").where(F.col("most").isNull() | (F.lit(100) * _wide(F.col("most")) < F.lit(own.covered) * _wide(F.col("a"))))
    # the best of each language by numbers; ties at its end are kept until phrases are there to part them
    names = limited(known.select("id", "lang", "word"))
    name = lambda k: names.select(F.col("id").alias(f"_{k}"), F.col("word").alias(f"_w{k}"), *([F.col("lang")] if k == 1 else []))
    listed = kept.select(*_IDS, "a", F.col("w.s").alias("score"), F.col("w.l").alias("l"), F.col("w.r").alias("r")).join(name(1), ids[0] == F.col("_1"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    listed = listed.withColumn("_k", F.rank().over(best)).where(F.col("_k") <= own.top)
    for k in (2, 3, 4):
        listed = listed.join(name(k), F.col(f"i{k}") == F.col(f"_{k}"), "left")
    phrase = F.concat_ws(" ", "_w1", "_w2", "_w3", "_w4")
    listed = listed.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("phrase", phrase)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = listed.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= own.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(own: Settings | None = None) -> str:
    """DuckDB SQL for ``mine``."""
    own = own or Settings()
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return f"""with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    runs as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
    words as (select lang, unnest(w) as word from runs),
    n as (select lang, count(*) as n from words group by lang),
    g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
      from runs, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k),
    f as (select lang, k, phrase, count(*)::hugeint as a from g group by all having count(*) >= {own.least}),
    c as (select *, string_split(phrase, ' ') as w from f where k > 1),
    cuts as (select c.lang, c.phrase, c.k, c.a, j, {part(1, 'j')} as x, {part('j + 1', 'c.k')} as y from c, (select unnest([1, 2, 3]) as j) where j < c.k),
    scored as (select cuts.*, l.a as l, r.a as r, (2000000 * cuts.a) // (l.a + r.a) as score from cuts
      join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
    weak as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    inner_ as (select c.lang, c.a, {part('p', 'p + m - 1')} as phrase from c, (select unnest([2, 3]) as m), (select unnest([1, 2, 3]) as p) where m < c.k and p + m - 1 <= c.k),
    covers as (select lang, phrase, max(a) as most from inner_ group by all),
    kept as (select weak.* from weak left join covers using (lang, phrase) where most is null or 100 * most < {own.covered} * weak.a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
    select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join n using (lang) where rank <= {own.top}"""
