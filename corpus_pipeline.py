"""The corpus pipeline: quality, toxicity, near-duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; other columns of ``docs`` are dropped, whatever
their names. Nulls may be in any column; an empty ``docs`` gives an empty result, in
every stage. Texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality_classifier, simhash_dedup, toxicity
from quarry.session import gather, spread, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TAIL = 0.5  # a document stays if the probability of the better grades is at least this
TOXIC = 0.5
WIDTH, SIMILAR = 5, 0.8  # near copies: Jaccard similarity of five-word shingles
MIX = mixing.Target(fraction=0.9, epochs=1)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose better grades are unlikely.

    A null text is judged as an empty one; a probability of exactly ``TAIL`` stays; rows that repeat
    are judged alike; without a usable label, or among empty ``docs``, all stay.
    """
    docs = gather(docs.select(*COLUMNS))
    model = quality_classifier.fit(docs, _labels(spark, sf_dir))
    judged = docs.withColumn("_grade", quality_classifier.grade(F.col("text"), model, 1, spark))
    return judged.where(F.col("_grade.tail_prob") >= TAIL).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic.

    A null text is scored as an empty one; a score of exactly ``TOXIC`` goes; rows that repeat are scored
    alike; without a usable label all stay.
    """
    docs = gather(docs.select(*COLUMNS))
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    if not model.trained:
        return docs
    scored = docs.withColumn("_score", toxicity.score(F.col("text"), model, spark))
    return scored.where(F.col("_score") < TOXIC).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that with the smallest id.

    Null and empty texts are one group; rows without an id stay only where no row of their group has
    one; of rows that share id and text one stays; rows that share an id alone each stand for their group.
    """
    return simhash_dedup.representatives(gather(docs.select(*COLUMNS)), WIDTH, SIMILAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents to the target weights; one epoch, so none comes twice.

    Null languages and sources count as empty names; rows that share an id are taken or left together;
    a document without tokens goes with its leaf's prefix; without any tokens nothing is taken.
    """
    return mixing.mix(gather(docs.select(*COLUMNS)), MIX).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; the schema is ``packing.SCHEMA``.

    A null or empty text is its end token alone; rows that repeat, and rows without an id, are packed like others.
    """
    return packing.pack(gather(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxic),
    ("simhash_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: Trained models, XXH64 and byte-pair encoding are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
