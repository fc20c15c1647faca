"""Keyword search by an inverted index, with the same answers as a scan of all texts.

A query's terms hold no white space, so a text holds a term exactly if one of its words does. Two tables
answer that: the distinct words, each once, and the documents of each word. The words are scanned for a term's n-grams of up to three
characters (or these are looked up in a table of them); words that really hold the term lead to documents. Texts are read for one purpose
only, to look for the whole phrase where a document holds every one of several terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.search import limit_of
from quarry.session import limited, stage

_GRAM = 3


def words_of(docs: DataFrame, document: str = "id", text: str = "text") -> DataFrame:
    """``(word, document_id)``: each document's distinct lower-cased words; null texts have none."""
    # as ``T.fields``, but that the empty word is left out when words are distinct rows
    words = F.array_distinct(F.split(F.lower(F.col(text)), T.SPACE_RUN))
    return docs.select(F.explode(words).alias("word"), F.col(document).alias("document_id")).where("word <> ''")


def _grams(word: Column) -> Column:
    """Distinct n-grams of one, two and three characters."""


    def parts(n: int) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substr(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, own).otherwise(F.array())

    return F.array_distinct(F.concat(*[parts(n) for n in range(1, _GRAM + 1)]))


def grams_of(words: DataFrame) -> DataFrame:
    """``(gram, word)`` of the distinct words of ``words(word)``."""
    return words.select("word").distinct().select(F.explode(_grams(F.col("word"))).alias("gram"), "word")


def words_with(words: DataFrame, grams: list[str]) -> DataFrame:
    """``(gram, word)`` of the words of ``words(word)`` that hold some of ``grams``, by a scan of them."""
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.col("word").contains(g))
    return words.select(F.explode(held).alias("gram"), "word")


def terms_of(spark, query: str) -> list[str]:
    """A query's terms, as the scan has them."""
    return list(spark.range(1).select(T.fields(F.lower(F.lit(query)))).first()[0])


def needed(term: str) -> list[str]:
    """The n-grams that every word holding ``term`` has: its own, or all of its three-character parts."""
    return [term] if len(term) <= _GRAM else sorted({term[i : i + _GRAM] for i in range(len(term) - _GRAM + 1)})


def holding(spark, terms: list[str], grams: Callable[[list[str]], DataFrame]) -> DataFrame:
    """``(term, word)``: the words that hold each term; ``grams`` looks rows ``(gram, word)`` up by grams."""
    asked = [(t, g, len(needed(t))) for t in sorted(set(terms)) for g in needed(t)]
    found = grams(sorted({g for _, g, _ in asked})).select("gram", "word").distinct()
    pairs = found.join(F.broadcast(spark.createDataFrame(asked, "term string, gram string, n int")), "gram")
    every = pairs.groupBy("term", "word").agg(F.count("*").alias("k"), F.first("n").alias("n")).where("k = n")
    return every.where(F.col("word").contains(F.col("term"))).select("term", "word")


def search(
    spark,
    query: str,
    limit: int | None,
    grams: Callable[[list[str]], DataFrame],
    postings: Callable[[DataFrame], DataFrame],
    texts: Callable[[DataFrame], DataFrame],
    least: float = 0.1,
) -> DataFrame:
    """``(document_id, score)`` as ``keyword_search`` has it.

    ``postings`` gives ``(word, document_id)`` of the rows of a table of words, ``texts`` gives ``(document_id, text)`` of those of ids.
    """
    terms = terms_of(spark, query)
    if not terms:
        return spark.createDataFrame([], "document_id string, score double")
    often = Counter(terms)
    words = stage(holding(spark, terms, grams), "words")
    held = postings(words.select("word").distinct()).select("word", "document_id").distinct()
    pairs = held.join(limited(words), "word").select("document_id", "term").distinct()
    weights = F.broadcast(spark.createDataFrame(list(often.items()), "term string, times long"))
    hits = stage(pairs.join(weights, "term").groupBy("document_id").agg(F.sum("times").alias("n")), "hits")
    base = F.col("n") / F.lit(len(terms))
    if len(terms) == 1:  # the phrase is the term
        scored = hits.select("document_id", (base + F.lit(0.3)).alias("score"))
    else:
        whole = hits.where(F.col("n") == len(terms)).select("document_id")
        phrase = texts(whole).where(F.lower("text").contains(" ".join(terms))).select("document_id", F.lit(0.3).alias("more")).distinct()
        scored = hits.join(phrase, "document_id", "left").select("document_id", (base + F.coalesce("more", F.lit(0.0))).alias("score"))
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), "document_id").limit(limit_of(limit))
