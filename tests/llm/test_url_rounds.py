"""Ranks spread until they settle."""

from __future__ import annotations

import pytest

from quarry.llm import url_filter


def test_distrust_reaches_hosts_over_thirty_links_away(spark):
    edges = spark.createDataFrame([(f"h{i + 1}", f"h{i}", 1) for i in range(33)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 0, 1)], "host string, trusted long, blocked long")
    got = {r.host: r.distrust for r in url_filter.propagate(edges, seeds).collect()}
    assert got["h33"] == pytest.approx(0.15 * 0.85**33 / (1 - 0.85**34))
    with pytest.raises(RuntimeError):
        url_filter.propagate(edges, seeds, url_filter.Settings(most_rounds=3))
