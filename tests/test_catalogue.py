"""Every catalogue query beside its SQL, and a look at those without SQL."""

from __future__ import annotations

import pytest

from quarry.catalogue import ORACLE_SQL, QUERIES
from tests.compare import both, database


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, small, con, name):
    got, want = both(con, QUERIES[name](spark, small), ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, small):
    """Columns that a query does not use are not read, and top-k is not a full sort."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = plan(QUERIES["vector_topk_chunks"](spark, small))
    assert "TakeOrderedAndProject" in top and "label" not in top
    profile = plan(QUERIES["text_profile"](spark, small))
    assert "Exchange" not in profile and "ReadSchema: struct<doc_id:bigint,text:string>" in profile
