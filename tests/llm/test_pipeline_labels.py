"""The pipeline's filters where there is nothing to learn from."""

from __future__ import annotations

import pytest

import corpus_pipeline as P

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[], [(10**9, 1, 1)], [(1, None, None), (None, 1, 1)]])
def test_filters_keep_all_without_usable_labels(spark, tmp_path, labels):
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a clean text", "en", "s", 12), (2, "", "en", "s", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (P.quality, P.toxic):
        kept = stage(spark, docs, str(tmp_path))
        assert tuple(kept.columns) == P.COLUMNS and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
