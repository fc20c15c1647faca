"""The ten operators beside brute force, exact round trips, and held-out labels, with odd rows in every table."""

from __future__ import annotations

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import ann_search, license_scan, mixing, packing, quality_classifier, quality_rules, sharding, simhash_dedup, toxicity, url_filter
from quarry.llm.graphs import connected_components
from quarry.llm.licenses import TEXTS
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import both, database

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _head string, _domain string, _score double, tokens long, shard int"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def table(spark, *texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "src1", len(t or ""), "h", "d", 1.0, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(20_000))
    texts = [None, "", "   \n", "one", "one two", "One Two", "a b c", long, long, long + " x", "\x0b\x1c\x85 z"]
    for _ in range(6):
        base = [word() for _ in range(40)]
        texts.append(" ".join(base))
        texts += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(0, 12, 3)]
    return texts + ["copy of a text here"] * 5


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# 7


def print_of(text):
    from xxhash import xxh64

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)].append(k)
    return [min(least[root(i)], default=None) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    texts = odd_texts()
    ids = [None if i in (3, 7) else 1000 - i for i in range(len(texts))]
    got = simhash_dedup.near_duplicates(table(spark, *texts, ids=ids)).select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("h"), "component_id")
    prints = [print_of(t) for t in texts]
    want = [(k, f"{p:016x}", c) for k, p, c in zip(ids, prints, components(ids, prints))]
    assert Counter(map(tuple, got.collect())) == Counter(want)


@pytest.mark.parametrize("crowd", [2, 16])
def test_links_join_what_differs_by_two_bits(spark, crowd):
    rng = random.Random(crowd)
    prints = {0, 1, 3, 7, 15, 31, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(12):  # chains, whose ends are far apart
            prints.add(p)
            p ^= 1 << rng.randrange(64)
            p ^= (1 << rng.randrange(64)) * rng.randrange(2)
    hub = rng.getrandbits(64)
    prints |= {hub ^ 1 << a for a in range(64)} | {hub}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash_dedup.links(df, crowd)).collect()}
    want = components(signed, prints)
    assert [roots.get(p, p) for p in signed] == want


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(order, 0), 1000: 1000, 1001: 1000}
    assert connected_components(links.limit(0)).count() == 0


def test_representatives_keep_one_of_each(spark):
    texts = odd_texts()
    ids = [None if i in (1, 2, 7) else i for i in range(len(texts))]
    frame = table(spark, *texts, ids=ids).unionByName(table(spark, texts[20], ids=[20]))
    kept = simhash_dedup.representatives(frame)
    assert kept.columns == frame.columns
    want = sorted({c for c in components(ids, [print_of(t) for t in texts]) if c is not None})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    nameless = simhash_dedup.representatives(table(spark, "a b c d", "a b c d", ids=[None, None]))
    assert [r.text for r in nameless.collect()] == ["a b c d"]
    assert simhash_dedup.representatives(frame.limit(0)).count() == 0


# 5

PATH = public_tokenizers.path("word_bpe_49k.json")
CHARS = st.sampled_from(list("abzAZ09'.,!?-_ \t\n\x0b\x1c\x85\xa0éÉßİıΣσςŃńn\u0301日本<|>@#😀") + ["<|endoftext|>", "it's", "'re", "ſ", "ﬁ"])


@settings(max_examples=400, deadline=None)
@given(st.lists(CHARS, max_size=40).map("".join))
def test_words_have_the_ids_of_the_whole_text(text):
    enc = packing.encoder(PATH)
    assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts_by_id, capacity=2048):
    tokenizer = packing.encoder(PATH).tokenizer
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts_by_id)
    for k, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts_by_id[k] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at < capacity and at.bit_count() == 1


def test_packing_round_trip(spark, docs):
    texts = odd_texts()
    check_pieces(packing.pack(table(spark, *texts).repartition(3), PATH).collect(), dict(enumerate(texts)))
    check_pieces(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert packing.pack(table(spark, "x").limit(0), PATH).count() == 0


def test_packing_takes_the_level_of_least_squares():
    rng = random.Random(0)
    packer = packing.Packer(64)
    done = []
    for k in range(500):
        size = rng.randint(1, 63)
        levels = packer.levels.copy()
        got = packer.level_for(size)
        cost = {}
        for h in range(64 - size + 1):
            if h == 0 or levels[h]:
                after = levels.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 64
                cost[h] = int((after[1:64] ** 2).sum())
        assert cost[got] == min(cost.values())
        done += packer.add(packing.Piece(k, 0, np.arange(size, dtype="<u4"), size))
        assert sum(map(len, packer.open.values())) == packer.levels.sum()
    done += packer.finish()
    sizes = [sum(len(p.ids) for p in w) for w in done]
    assert all(s == 64 or s.bit_count() == 1 for s in sizes) and sizes.count(64) >= len(sizes) - 6


# 4


def test_sharding(spark, docs):
    frame = docs.select("doc_id", "text").unionByName(table(spark, *odd_texts()).select("doc_id", "text"))
    frame = frame.unionByName(spark.createDataFrame([(None, None), (1, None), (1, None), (2, "é")], "doc_id long, text string"))
    rows = sharding.shard(frame).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in frame.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(frame.limit(0)).count() == 0


def test_shards_are_even_and_groups_stay_together(spark):
    rng = random.Random(5)
    texts = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) + str(i // 2) for i in range(3000)]
    texts = [t if i % 2 == 0 else texts[i - 1] for i, t in enumerate(texts)] + ["a hot text that is there very often"] * 1500
    rows = sharding.shard(table(spark, *texts)).collect()
    size, count, where = Counter(), Counter(), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        count[r.shard] += 1
        where[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.005 * mean and min(size.values()) > 0.995 * mean
    assert max(count.values()) < 1.2 * len(rows) / 24
    hot = zlib.crc32(texts[-1].encode())
    assert all(len(s) == 1 for k, s in where.items() if k != hot) and len(where[hot]) > 1


# 9


def test_mixing_against_sql(spark, small):
    con = database(small)
    got, want = both(con, QUERIES["op9_mixing"](spark, small), ORACLE_SQL["op9_mixing"])
    assert got == want and got


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = [("A", "x", "1", 10), ("A", "x", "2", 1000), ("A", "y", "1", 5), ("B", "x", "1", 10_000)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    target = mixing.Target(domain={"A": 1.0, "B": 1.0}, lang={"x": 1.0, "y": 1.0}, source={}, fraction=1000 / sum(x[3] for x in leaves), epochs=1)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(frame, target).collect()}
    # each domain gets 500; of A's, y holds 5 and x takes the rest, of which source 1 holds 10
    assert got == pytest.approx({("A", "y", "1"): 5, ("A", "x", "1"): 10, ("A", "x", "2"): 485, ("B", "x", "1"): 500})
    scarce = [("A", "x", "1", 10), ("A", "y", "1", 5), ("B", "x", "1", 10_000)]
    target = mixing.Target(domain={"A": 1.0, "B": 1.0}, lang={}, source={}, fraction=1000 / 10_015, epochs=1)
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(spark.createDataFrame(scarce, frame.schema), target).collect()}
    assert got == pytest.approx({("A", "x"): 10, ("A", "y"): 5, ("B", "x"): 985})


def filled(leaves, target, level=0, budget=None):
    """Budgets by plain recursion: what a child can't hold goes to its siblings, again and again."""
    names, weights = mixing.LEVELS, target.rest
    weight = lambda leaf, k: getattr(target, names[k]).get(leaf[k], weights[k])
    if budget is None:
        budget = sum(leaf[3] for leaf in leaves) * target.fraction
        leaves = [leaf for leaf in leaves if all(weight(leaf, k) > 0 for k in range(3))]
    if level == 3:
        return {leaf[:3]: min(budget, leaf[3] * target.epochs) for leaf in leaves}
    children = defaultdict(list)
    for leaf in leaves:
        children[leaf[level]].append(leaf)
    holds = {c: sum(leaf[3] for leaf in own) * target.epochs for c, own in children.items()}
    heavy = {c: weight(own[0], level) for c, own in children.items()}
    given, open_ = dict.fromkeys(children, 0.0), set(children)
    while open_ and budget > 1e-9:
        share = budget / sum(heavy[c] for c in open_)
        budget = 0.0
        for c in sorted(open_):
            given[c] += share * heavy[c]
            if given[c] >= holds[c]:
                budget += given[c] - holds[c]
                given[c] = holds[c]
                open_.discard(c)
    out = {}
    for c, own in children.items():
        out |= filled(own, target, level + 1, given[c])
    return out


SHAPE = "domain string, lang string, source string, tokens long"


def test_weights_of_zero_lend_no_capacity(spark):
    leaves = [("A", "x", "1", 100), ("A", "z", "1", 10_000), ("B", "x", "1", 10_000)]
    target = mixing.Target(domain={"A": 1.0, "B": 1.0}, lang={"x": 1.0, "z": 0.0}, source={}, fraction=1000 / 20_100, epochs=1)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(spark.createDataFrame(leaves, SHAPE), target).collect()}
    assert got == pytest.approx({("A", "x", "1"): 100, ("B", "x", "1"): 900}) and got == pytest.approx(filled(leaves, target))


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_recursion(spark, seed):
    rng = random.Random(seed)
    leaves = [(d, x, s, rng.choice([0, 3, 50, 1000, 20_000])) for d in "ABC" for x in "xyz" for s in "1234" if rng.random() < 0.8]
    weights = lambda names: {k: rng.choice([0.0, 0.5, 1.0, 3.0]) for k in names}
    target = mixing.Target(weights("AB"), weights("xy"), weights("123"), fraction=rng.choice([0.1, 0.6, 2.0]), epochs=rng.choice([1, 2]))
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(spark.createDataFrame(leaves, SHAPE), target).collect()}
    assert got == pytest.approx(filled(leaves, target), abs=1e-3)


@pytest.mark.parametrize("few", [1, 64])
def test_prefixes_of_leaves_against_running_sums(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "_FEW", few)
    rng = random.Random(few)
    texts = [" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(30))) for _ in range(700)]
    rows = [(None if i % 90 == 0 else i // 2 if i % 50 == 0 else i, t, "en" if i % 3 else "de", f"src{min(i % 12, 1)}") for i, t in enumerate(texts)]
    target = mixing.Target(fraction=0.55, epochs=2)
    got = Counter((r.doc_id, r.text, r._epoch) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), target).collect())
    leaves = defaultdict(list)
    for k, t, lang, source in rows:
        leaves["crawl", lang, source].append((k, t))
    budgets = filled([(*leaf, sum(len(t.split()) for _, t in own)) for leaf, own in leaves.items()], target)
    want = Counter()
    for leaf, own in leaves.items():
        tokens = sum(len(t.split()) for _, t in own)
        whole = min(int((budgets[leaf] + 1e-6) // tokens), target.epochs)
        want += Counter((k, t, e) for k, t in own for e in range(whole))
        left, keyed = budgets[leaf] - whole * tokens, defaultdict(list)
        for k, t in own:
            keyed[hashlib.md5(f"{target.seed}:{whole}:{'' if k is None else k}".encode()).hexdigest()].append((k, t))
        for key in sorted(keyed) if whole < target.epochs else []:
            left -= sum(len(t.split()) for _, t in keyed[key])
            if left < -1e-6:
                break
            want += Counter((k, t, whole) for k, t in keyed[key])
    assert got == want


def test_mixing_of_odd_rows(spark):
    frame = table(spark, *odd_texts()).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 2 > 0, F.col("source")))
    target = mixing.Target(fraction=0.5, epochs=2)
    rows = mixing.mix(frame.unionByName(frame.where("doc_id = 20")), target)
    assert rows.columns == [c for c in frame.columns if c != "_domain"] + ["_domain", "_epoch"]
    total = sum(len(words_of(t)) for t in odd_texts())
    assert 0 < sum(len(words_of(r.text)) for r in rows.collect()) <= 0.5 * total + 40
    everything = mixing.mix(frame, mixing.Target(domain={}, lang={}, source={}, rest=(1.0, 1.0, 1.0), fraction=1.0, epochs=1))
    assert everything.count() == frame.count()
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mix(table(spark, None, "")).count() == 0


# 1


def nearest(ids, vectors, queries, k):
    out = {}
    for q in queries:
        at = [i for i in range(len(ids)) if ids[i] != ids[q]]
        scores = vectors[at] @ vectors[q]
        best = sorted(zip(-scores, [ids[i] for i in at]))[:k]
        out[ids[q]] = [(i, -s) for s, i in best]
    return out


def test_ann_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, m = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    want = nearest(ids, m, [i for i, k in enumerate(ids) if k % 20 == 0], 20)
    got = defaultdict(list)
    for r in sorted(QUERIES["op1_ann_search"](spark, small).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert set(got) == set(want) and np.mean(hits) >= 0.9
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(m[ids.index(i)] @ m[ids.index(q)]), abs=1e-9)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_windows_count_each_entry_once():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 16)) * rng.uniform(0.2, 3, (300, 1))
    vectors[7] = vectors[9]
    s = ann_search.Settings(projections=12, k=5)
    index = ann_search.Index(np.arange(300), np.arange(300), vectors, s)
    centre = (vectors[:4] / np.linalg.norm(vectors[:4], axis=1)[:, None]).astype(np.float32) @ index.lines[:-1]
    at = (index.points @ index.lines).T
    old = index.windows(centre, np.zeros(4, np.float32))
    for q in range(4):
        count = np.bincount(index.entered((old[0][q], old[0][q]), (old[0][q], old[1][q])), minlength=300)
        bounds = old[0][q], old[1][q]
        for radius in (0.1, 0.4, 0.5, 1.7):
            lo, hi = index.windows(centre[q : q + 1], np.array([radius], np.float32))
            count += np.bincount(index.entered(bounds, (lo[0], hi[0])), minlength=300)
            bounds = lo[0], hi[0]
            low, high = centre[q] - np.float32(radius), centre[q] + np.float32(radius)
            assert count.tolist() == ((at >= low[:, None]) & (at <= high[:, None])).sum(axis=0).tolist()


def test_few_vectors_of_clusters_are_verified():
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.standard_normal((100, 64)), 60, axis=0) + 0.35 * rng.standard_normal((6000, 64))
    ids = np.arange(6000)
    index = ann_search.Index(ids, ids, vectors, ann_search.Settings())
    found, work = index.search(ids[::100], vectors[::100])
    want = nearest(ids.tolist(), vectors, range(0, 6000, 100), 20)
    hits = [len(set(places.tolist()) & {i for i, _ in want[q]}) / 20 for q, (places, _) in zip(range(0, 6000, 100), found)]
    assert np.mean(hits) >= 0.95 and work.verified < 0.05 * work.pairs and work.entered <= work.pairs * 64


def test_ann_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 8), (140, [math.nan] * 8), (160, [1.0] * 7 + [math.inf]), (180, [1.0] * 7 + [None]), (200, [1.0, 2.0])]
    rows += [(300 + i, [9.0] * 8) for i in range(50)] + [(20, [3.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = defaultdict(list)
    for r in sorted(ann_search.search(frame, F.col("vec_id") % 20 == 0, ann_search.Settings(block=40, query_block=2, least_queries=1)).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    # the row that repeats the id 20 is a query and a candidate of its own; the one vector of another length has no candidates
    assert set(got) == {0, 20, 40, 300, 320, 340} and all(len(v) == 20 * (1 + (k == 20)) for k, v in got.items())
    assert got[300] == [301 + i for i in range(20)]
    few = frame.where("vec_id < 5 or vec_id = 40")
    assert [r.vec_id for r in ann_search.search(few, F.col("vec_id") == 40).collect()].__len__() == 5
    for none in (frame.limit(0), frame.where("vec_id in (100, 120)"), frame.where("vec_id = 1")):
        assert ann_search.search(none, F.col("vec_id") % 20 == 0).count() == 0


# 2


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?q#f", "https://example.com/en/8", "x://com/en/", "//nohost", None, "http://a.net/de/1", "http://example.net/de/81", "http://aexample.net/de/8", "http://es.org/es/#x", "http://es.org/fr", "ftp://b.org:80/es/", "http://x.com"]
    frame = spark.createDataFrame([(i, u, None if i % 2 else "<a href='/x'>", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(frame).collect()}
    want = ["example.com/en/7", "com/en/", "com/en/", None, None, "net/de/", "example.net/de/8", "net/de/", "org/es/", None, None, None]
    assert [got[i].rule for i in range(len(urls))] == want
    assert (got[0].host, got[0].path) == ("a.example.com", "/en/7x") and (got[4].host, got[4].path) == ("", "") and (got[11].host, got[11].path) == ("x.com", "")
    assert [got[i].verdict for i in (0, 1, 5, 6, 3, 4)] == ["allow", "block", "allow", "block", "allow", "allow"]
    assert url_filter.judge(frame.limit(0)).count() == 0


def rank_of(edges, seeds, damping, rounds):
    total = sum(seeds.values())
    rank = {h: s / total for h, s in seeds.items() if s}
    for _ in range(rounds):
        new = Counter({h: (1 - damping) * s / total for h, s in seeds.items() if s})
        for a, r in rank.items():
            out = {b: n for (x, b), n in edges.items() if x == a}
            for b, n in out.items():
                new[b] += damping * r * n / sum(out.values())
        rank = new
    return rank


def test_propagation_against_power_iteration(spark):
    rng = random.Random(2)
    edges = Counter((f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(40))
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    trusted, blocked = {"h1": 3, "h2": 1}, {"h5": 2, "h7": 2}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([(h, trusted.get(h, 0), blocked.get(h, 0)) for h in {*trusted, *blocked}], "host string, trusted long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(frame, seeds, url_filter.Settings(most_rounds=8, tolerance=0)).collect()}
    t = rank_of(edges, trusted, 0.85, 8)
    d = rank_of({(b, a): n for (a, b), n in edges.items()}, blocked, 0.85, 8)
    for h in {*t, *d}:
        assert got[h] == pytest.approx((t.get(h, 0) / sum(t.values()), d.get(h, 0) / sum(d.values())), abs=1e-12)


def test_rank_that_can_not_be_passed_on_returns_to_the_seeds(spark):
    rng = random.Random(9)
    edges = {(f"h{a}", f"h{rng.randrange(14)}"): rng.randint(1, 4) for a in range(8) for _ in range(3)}  # h8 to h13 have no links
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    trusted = {"h1": 3, "h2": 1, "h12": 1}
    out, seed = Counter(), {h: n / 5 for h, n in trusted.items()}
    for (a, _), n in edges.items():
        out[a] += n
    rank = dict(seed)
    for _ in range(200):
        new = {h: p * (0.15 + 0.85 * sum(r for x, r in rank.items() if not out[x])) for h, p in seed.items()}
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / out[a]
        rank = new
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([(h, n, 0) for h, n in trusted.items()], "host string, trusted long, blocked long")
    got = {r.host: r.trust for r in url_filter.propagate(frame, seeds, url_filter.Settings(tolerance=1e-9)).collect()}
    assert got == pytest.approx({h: r for h, r in rank.items() if r}, abs=1e-7) and sum(got.values()) == pytest.approx(1)


def test_hosts_that_link_to_blocked_ones_are_blocked(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<a class=x href="{u}">y</a>' for u in links))
    rows = [page(1, "http://bad.com/en/1"), page(2, "http://farm.io/1", "http://bad.com/x", "//BAD.com/y"), page(3, "http://good.net/de/1", "https://friend.io/a"), page(4, "http://friend.io/1"), page(5, "http://alone.io/")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


# 3


def counts_of(text):
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_statistics_against_brute_force(spark, docs):
    texts = odd_texts() + ["a b a b a b a b", "x\nx\n \n \nx y\n", "#é*$%&|<>!\U0001f600", "a a a a", " lead\x1cx\u2028y trail "] + [r.text for r in docs.limit(100).collect()]
    got = quality_rules.stats(table(spark, *texts), "doc_id").collect()
    assert {r.doc_id: tuple(r[c] for c in quality_rules.COUNTS) for r in got} == {i: counts_of(t) for i, t in enumerate(texts)}


def test_rules_are_learnt(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        bad = i % 5 == 0
        tail = "" if not bad else "%$" if i % 2 else "!"
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 9) - len(tail))) + tail for _ in range(rng.randint(55, 90))]
        rows.append((i, " ".join(words), int(not bad)))
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(frame, labels).collect()}
    assert all(got[i].kept == bool(q) for i, _, q in rows)
    assert len({r.rule for r in got.values()} - {None}) == 2
    assert quality_rules.judge(frame, labels.limit(0)).where("kept").count() == len(rows)
    assert quality_rules.judge(frame.limit(0), labels).count() == 0


def test_base_rules_come_first(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "x " * 60), (-2, "x " * 60)], "doc_id long, text string"))
    rows = quality_rules.judge(frame, labels).collect()
    assert len(rows) == frame.count()
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and (r.kept is False or not failed)


# 8 and 10


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    rows = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    out = [(x.toxic, rows[x.doc_id].predicted) for x in labels if held_out(x.doc_id)]
    assert np.mean([a == b for a, b in out]) > 0.96
    assert not any(p for y, p in out if not y) or np.mean([p for y, p in out if not y]) < 0.01


def test_toxicity_learns_pairs_and_skips(spark):
    rng = random.Random(8)
    filler = lambda n: [f"f{rng.randrange(40)}" for _ in range(n)]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        rows.append((i, " ".join([*filler(6), "red", *filler(i % 2), "fish" if toxic else "bird", *filler(4), "bird" if toxic else "fish"]), int(toxic)))
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = model.scores([t for _, t, _ in rows])
    assert np.mean([(p >= 0.5) == bool(y) for p, (i, _, y) in zip(got, rows) if held_out(i)]) > 0.95


def test_classifiers_without_labels_and_with_odd_rows(spark):
    frame = table(spark, *odd_texts())
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    scores = frame.select(toxicity.score(F.col("text"), toxicity.fit(frame, none), spark).alias("s")).collect()
    assert {r.s for r in scores} == {0.5} and len(scores) == frame.count()
    tails = frame.select(quality_classifier.grade(F.col("text"), quality_classifier.fit(frame, none), 1, spark).alias("g")).collect()
    assert {r.g.tail_prob for r in tails} == {1.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)] + [(4, 0, 0)], "doc_id long, toxic int, quality int")
    model = quality_classifier.fit(frame, one)
    assert model.grades == (1,) and set(model.judge(["x", None], 1)[1]) == {1.0}
    assert frame.limit(0).select(toxicity.score(F.col("text"), toxicity.fit(frame.limit(0), one), spark)).count() == 0


def test_scores_do_not_depend_on_neighbours():
    texts = [None, "", "a b", "idiot x", "B a", "x" * 3_000_000, "a b"]
    model = toxicity.FTRL(toxicity.Settings(l1=0.1)).fit(toxicity.features(["idiot a", "a b"] * 20, 20), [1, 0] * 20)
    at = np.arange((1 << 20) + 1)
    w = model.weights(at)
    m = toxicity.Model(20, np.flatnonzero(w[:-1]), w[np.flatnonzero(w[:-1])], float(w[-1]))
    assert m.scores(texts).tolist() == [m.scores([t])[0] for t in texts]
    assert m.scores(["idiot x"])[0] > 0.5 > m.scores(["a b"])[0] and m.scores(["a b"])[0] == m.scores(["A\tb"])[0]


def test_ordinal_grades():
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        g = i % 4
        rows.append((" ".join(rng.choice(["good", "fine"]) if rng.random() < g / 3 else rng.choice(["bad", "poor"]) for _ in range(30)), g))
    seen = quality_classifier.sparse_rows([t for t, _ in rows[:1000]], quality_classifier.Settings().bits)
    model = quality_classifier.train(seen, [g for _, g in rows[:1000]], quality_classifier.Settings())
    assert model.grades == (0, 1, 2, 3) and (np.diff(model.theta) > 0).all()
    mean, tail = model.judge([t for t, _ in rows[1000:]], 2)
    truth = np.array([g for _, g in rows[1000:]])
    assert np.abs(mean - truth).mean() < 0.3 and ((tail >= 0.5) == (truth >= 2)).mean() > 0.93


def test_quality_on_held_out_rows(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    rows = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, sf).collect()}
    out = [(x.quality, rows[x.doc_id].kept) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if held_out(x.doc_id)]
    assert np.mean([bool(a) == b for a, b in out]) > 0.97
    assert np.mean([b for a, b in out if a]) > 0.99


# 6


def test_licences(spark, small):
    con = database(small)
    got, want = both(con, QUERIES["op6_license_scan"](spark, small), ORACLE_SQL["op6_license_scan"])
    assert got == want
    mit = dict(TEXTS)["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace('"', "“"), mit.replace("License", "Licence"), mit + " extra", None, "", "© 2020 x", "text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0\n"]
    rows = {r.doc_id: r for r in license_scan.scan(table(spark, *texts)).collect()}
    assert [rows[i].license for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert rows[4].digest is None and rows[5].digest == rows[6].digest and rows[7].notices == "CC-BY-NC-4.0,MIT"
    assert license_scan.scan(table(spark, "x").limit(0)).count() == 0


def test_licences_wrapped_and_spelt_otherwise(spark):
    import textwrap

    bsd2, bsd3, mit = (dict(TEXTS)[k] for k in ("BSD-2-Clause", "BSD-3-Clause", "MIT"))
    wraps = ["\n".join(textwrap.fill(part, w) for part in bsd2.split("\n")) for w in range(20, 100)]
    assert any(line.lower().startswith("copyright") for t in wraps for line in t.split("\n"))
    notices = ["Copyright (c) 2020, A. Name", "Copyright 1999-2003 by X", "copyright © X", "Copyright: X", "(c) 2001 Y", "Copyright Some One", "  Copyright Example Inc.\nAll rights reserved."]
    texts = wraps + [f"{n}\n\n{bsd2}" for n in notices]
    rows = license_scan.scan(table(spark, *texts)).collect()
    assert {r.license for r in rows} == {"BSD-2-Clause"} and len(rows) == len(texts)
    other = license_scan.scan(table(spark, bsd3.replace("copyright holder", "copyright owner"), mit.replace("sublicense", "sub-license"), "x " + mit)).collect()
    assert [r.license for r in sorted(other, key=lambda r: r.doc_id)] == ["BSD-3-Clause", "MIT", None]


def test_licences_known_by_digest(spark):
    """Against the published texts, where the system has them."""
    import os

    home = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    there = {k: f"{home}/{v}" for k, v in files.items() if os.path.exists(f"{home}/{v}")}
    if not there:
        pytest.skip("no licence texts here")
    texts = [open(v, encoding="utf-8").read() for v in there.values()]
    rows = license_scan.scan(table(spark, *texts, *[t.upper() for t in texts])).collect()
    assert [r.license for r in sorted(rows, key=lambda r: r.doc_id)] == [*there, *there]


def test_texts_are_normal():
    for _, t in TEXTS:
        assert unicodedata.is_normalized("NFC", t)


@pytest.mark.parametrize("name, module", [("op2_url_filter", url_filter), ("op3_quality_rules", quality_rules), ("op9_mixing", mixing)])
def test_native_operators_run_no_python(spark, small, monkeypatch, name, module):
    plans, stage = [], module.stage

    def watched(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, *rest)

    monkeypatch.setattr(module, "stage", watched)
    out = QUERIES[name](spark, small)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any(word in p for p in plans for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
