"""The registered queries ``opN_<name>`` and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann_search, license_scan, main_text, mixing, packing, phrases, quality_classifier, quality_rules, ranked_search, sharding, simhash_dedup, toxicity, url_filter
from quarry.llm.labelled import held_out
from quarry.session import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages") else df


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(_read(spark, sf_dir, "documents"))
    return taken.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_epoch").alias("epoch"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _read(spark, sf_dir, "labels"))
    graded = docs.select("doc_id", quality_classifier.grade(F.col("text"), model, 1, spark).alias("g"))
    return graded.select("doc_id", "g.expected_grade", "g.tail_prob", (F.col("g.tail_prob") >= 0.5).alias("kept"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_read(spark, sf_dir, "pages"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ann_search,
        op2_url_filter,
        op3_quality_rules,
        op4_sharding,
        op5_packing,
        op6_license_scan,
        op7_simhash_dedup,
        op8_toxicity,
        op9_mixing,
        op10_quality_classifier,
        op11_phrases,
        op12_main_text,
        op13_ranked_search,
        pipeline,
    )
}

#: SQL for what SQL can express. Iterative, learnt, and hashed results are held against brute force in tests.
ORACLE_SQL: dict[str, str] = {"op6_license_scan": license_scan.oracle(), "op9_mixing": mixing.oracle(), "op11_phrases": phrases.oracle(), "op13_ranked_search": ranked_search.oracle()}
