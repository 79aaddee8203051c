"""Every registered query runs, and agrees with its oracle."""

import pytest

from tests.cases import CASES
from tests.oracle import differences
from tidemark.plans import catalogue, discovery, shop, signed  # noqa: F401  all register their queries
from tidemark.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    if name in ORACLES:
        assert differences(spark, QUERIES[name], ORACLES[name], sf_dir) is None
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", CASES)
def test_case(spark, sf_dir, name):
    assert differences(spark, *CASES[name], sf_dir) is None


def test_search_comes_in_browse_order(spark, sf_dir):
    from tidemark.operators.search import search
    from tidemark.plans import views

    found = search(views.entries(spark, sf_dir), views.apps(spark), "")
    rows = [(not r.featured, -r.added_at, r.subject_id) for r in found.collect()]
    assert rows == sorted(rows) and len(rows) > 100
    assert "Sort [featured" in found._jdf.queryExecution().optimizedPlan().toString()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_pushes_columns_and_broadcasts_the_registry(spark, sf_dir):
    from tidemark.operators.search import search
    from tidemark.plans import views

    plan = search(views.entries(spark, sf_dir), views.apps(spark), "tion")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "n_chars" not in plan
