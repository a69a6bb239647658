"""Plans with windows over documents: tasks as many as the markup needs, whatever the session's number of partitions."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import corpus
from leafmill.plans import registry

DEALT = ["utility_roots", "furniture_roots", "clean_paragraphs", "subtree_counts"]


@pytest.mark.parametrize("name", DEALT)
def test_tasks_grow_with_the_markup(spark, sf_dir, monkeypatch, name):
    size = spark.read.parquet(f"{sf_dir}/pages.parquet").agg(F.sum(F.octet_length("html") + corpus.EACH_BYTES)).first()[0]
    monkeypatch.setattr(corpus, "DEALT_BYTES", size // 64)
    tasks = registry.queries()[name](spark, sf_dir).select(F.spark_partition_id().alias("task")).distinct().count()
    assert 16 < tasks <= 66  # some of 64 get none of the few documents


def test_documents_without_markup_count(spark, monkeypatch):
    monkeypatch.setattr(corpus, "DEALT_BYTES", 5 * corpus.EACH_BYTES)
    docs = spark.range(400).selectExpr("id", "cast(null as string) html")
    nodes = corpus.parse_nodes(docs, by=["id"])
    assert nodes.rdd.getNumPartitions() == 80 and nodes.select("id").distinct().count() == 400
    assert corpus.parse_nodes(docs.where("id < 0"), by=["id"]).count() == 0


@pytest.mark.parametrize("name", ["clean_paragraphs", "subtree_counts"])
def test_parsing_is_dealt_too(spark, sf_dir, monkeypatch, name):
    """A task that parses a whole split holds the nodes of all of it when it writes them to more than 200 tasks."""
    size = spark.read.parquet(f"{sf_dir}/pages.parquet").agg(F.sum(F.octet_length("html") + corpus.EACH_BYTES)).first()[0]
    monkeypatch.setattr(corpus, "DEALT_BYTES", size // 64)
    found, context = registry.queries()[name](spark, sf_dir), spark.sparkContext
    context.setJobGroup(f"dealt-{name}", name)
    try:
        found.write.format("noop").mode("overwrite").save()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(f"dealt-{name}") for s in told.getJobInfo(j).stageIds}
    assert sum(told.getStageInfo(s).numTasks >= 64 for s in stages if told.getStageInfo(s)) >= 2  # parsing, and the windows
