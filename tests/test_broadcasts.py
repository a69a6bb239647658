"""Joins of tables that grow with the corpus send none of them through the driver, however small their files are."""

import pytest

from leafmill.operators import candidates
from leafmill.plans import registry
from leafmill.sources.tables import kept

KEY = ["page_id"]


def sent(df):
    """The broadcasts of a plan, as it was made and as it ran."""
    run = df._jdf.queryExecution().executedPlan()
    made = run.toString()
    run.executeCollect()
    return [line for line in (made + run.toString()).splitlines() if "Broadcast" in line]


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return kept(candidates.measured(pages, base_url="url"), "candidates")


def test_content_candidates_broadcasts_nothing(spark, sf_dir):
    assert sent(registry.queries()["content_candidates"](spark, sf_dir)) == []


@pytest.mark.parametrize("reading", [True, False])
def test_ranking_broadcasts_nothing(found, reading):
    assert sent(candidates.ranked(found, KEY, reading)) == []


@pytest.mark.parametrize("name", ["relational_nav_links", "relational_siblings", "relational_not_has"])
def test_selectors_as_joins_broadcast_nothing(spark, sf_dir, name):
    assert sent(registry.queries()[name](spark, sf_dir)) == []
