from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import units as U
from quarry.operators.chunking import chunk_documents, pack_table, packed_counts, word_windows
from quarry.operators.units import Chunk, Chunker

WORDS = st.sampled_from(["alpha", "beta", "gamma,", "delta.", "eps!", "zeta?", "eta\n\n", "class", "# x\n", "- y", "ä", "   "])
TEXTS = st.lists(WORDS, max_size=120).map(" ".join)


def test_bounds_are_checked():
    for a, b in [(10, 10), (10, 11), (0, 0), (5, -1)]:
        with pytest.raises(ValueError):
            Chunker(a, b)


def test_small_and_empty_texts():
    assert Chunker().chunk(None) == Chunker().chunk("  \n ") == []
    assert Chunker().chunk(" a b ") == [Chunk("a b", 2, "text")]


def test_word_windows_overlap():
    words = [f"w{i}" for i in range(14)]
    got = Chunker(5, 1).by_words(Chunk(" ".join(words), 14, "text"))
    assert [c.text.split() for c in got] == [words[0:5], words[4:9], words[8:13], words[12:14]]
    assert [(c.start, c.token_count) for c in got] == [(0, 5), (4, 5), (8, 5), (12, 2)]


def test_overlap_is_the_longest_run_that_fits():
    units = ["a b", "c d e", "f", "g h i j"]
    sizes = list(map(U.tokens, units))
    assert list(Chunker(50, 4).overlaps(units, sizes, "text")) == [[], [0], [1], [1, 2]]
    assert list(Chunker(50, 0).overlaps(units, sizes, "text")) == [[], [], [], []]


@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), max_size=25), st.integers(0, 30))
def test_code_overlap_by_its_rule(parts, overlap):
    units, sizes = ["class a" if marked else "x = 1" for _, marked in parts], [n for n, _ in parts]
    budget = int(overlap * 1.2)
    plain = []
    for at in range(len(units)):
        left, places = budget, set()
        for i in reversed(range(at)):
            if left > 0 and (sizes[i] <= left or parts[i][1]):
                places.add(i)
                left -= sizes[i]
        plain.append(sorted(places))
    assert list(Chunker(50, overlap).overlaps(units, sizes, "code")) == plain


def test_code_overlap_keeps_constructs():
    units = ["class Big one two three four", "x", "long long long long long", "y"]
    sizes = list(map(U.tokens, units))
    assert list(Chunker(50, 3).overlaps(units, sizes, "code"))[3] == [0, 1]


def test_packing_repeats_units():
    units = ["a b c", "d e", "f g h", "i"]
    got = Chunker(6, 2).pack(units, "text")
    assert [(c.text, c.token_count) for c in got] == [("a b c d e", 5), ("d e\n f g h i", 6)]


def test_code_is_split_by_lines():
    got = Chunker(4, 1).by_lines(Chunk("a b\nc d\ne f g h i\nj", 10, "code"))
    assert [(c.text, c.token_count, c.end_pos) for c in got] == [("a b\nc d", 4, 0), ("e f g h i", 5, 0), ("j", 1, 0)]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 40), st.integers(0, 4))
def test_chunks_stay_within_the_limit(text, most, overlap):
    got = Chunker(most, overlap).chunk(text)
    for c in got:
        assert c.text == U.trim(c.text) and c.text
        # a line of code is never split, and an overlap's joint may part a unit's mark from it
        assert c.token_count <= most or c.kind == "code" or len(U.fields(c.text)) <= most
    if U.kind_of(U.trim(text)) == "prose":
        words = lambda s: {w.rstrip(".") for w in U.fields(s)}
        assert words(text) - {""} <= set().union(*(words(c.text) for c in got))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_python_and_column_functions_agree_on_kinds(text):
    assert U.kind_of(text) in ("code", "structured", "prose", "text")
    assert sum(map(U.tokens, U.paragraphs(text))) <= U.tokens(text)


def test_units_agree_with_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    extra = spark.createDataFrame([("a.\n\nb.\n\nc. d. tail",), ("x   y\n \nz",), ("",), ("\x0bv \xa0 w　",), ("function a() { return 12345 }\nclass B that is long",)], "text string")
    for name in ("paragraphs", "sentences", "code_blocks", "wide_parts", "sentence_units"):
        for r in docs.unionByName(extra).select("text", getattr(T, name)(F.col("text")).alias("u")).collect():
            assert r.u == getattr(U, name)(r.text)


def test_pack_agrees_with_the_fold_in_the_jvm(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text <> ''")
    for r in docs.select("text", packed_counts(F.col("text"), 60, 9).alias("c")).collect():
        assert r.c == [c.token_count for c in Chunker(60, 9).pack(U.sentence_units(r.text), "text")]


def test_chunk_documents(spark):
    long = ". ".join(f"sentence number {i} goes here" for i in range(80)) + "."
    docs = spark.createDataFrame([(1, long), (2, " short one "), (3, ""), (4, None), (5, "class " + "x " * 300)], "doc_id long, text string")
    got = chunk_documents(docs, max_tokens=100, overlap=10).orderBy("document_id", "chunk_index").collect()
    assert {r.document_id for r in got} == {1, 2, 5}
    assert [r.chunk_text for r in got if r.document_id == 2] == [" short one "]
    first = [r for r in got if r.document_id == 1]
    assert [r.chunk_index for r in first] == list(range(len(first))) and first[1].chunk_id == "1_chunk_1"
    assert [(r.chunk_text, r.token_count) for r in first] == [(c.text, c.token_count) for c in Chunker(100, 10).chunk(long)]


def test_word_windows_column(spark):
    text = " ".join(map(str, range(25)))
    rows = spark.createDataFrame([(text,), ("",), ("one",)], "t string").select(word_windows(F.col("t"), 10, 3).alias("w")).collect()
    assert [[(x.window_text.split()[0], x.token_count) for x in r.w] for r in rows] == [[("0", 10), ("7", 10), ("14", 10), ("21", 4)], [], [("one", 1)]]


def test_pack_table(spark):
    rows = spark.createDataFrame([("a", i, f"r{i} x y\n") for i in range(5)] + [("b", 0, "one " * 9)], "t string, o long, r string")
    got = pack_table(rows, "t", "o", "r", 7).orderBy("table_id", "chunk_index").collect()
    assert [(r.table_id, r.chunk_index, r.token_count) for r in got] == [("a", 0, 6), ("a", 1, 6), ("a", 2, 3), ("b", 0, 9)]
    assert got[0].chunk_text == "r0 x y\nr1 x y\n"


def test_table_functions_in_sql(spark):
    from quarry.functions.registry import register

    register(spark)
    spark.createDataFrame([(1, "a b"), (2, None), (3, "x. " * 300)], "id int, t string").createOrReplaceTempView("some_docs")
    got = spark.sql("select id, c.* from some_docs, lateral chunk_text(t, 50, 5) c").collect()
    assert {r.id for r in got} == {1, 3}
    assert [(r.chunk_text, r.token_count) for r in got if r.id == 3] == [(c.text, c.token_count) for c in Chunker(50, 5).chunk("x. " * 300)]
    assert spark.sql("select section_text from html_sections('<h1>a</h1><p>b</p>')").first()[0] == "## a\n\nb\n\n"
