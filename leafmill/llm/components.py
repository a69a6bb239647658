"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_one, saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable over ``edges``; nodes without an edge are not listed.

    Every round takes the least label among neighbours (combined before it moves, so a
    node with very many neighbours costs its edges once) and then the label of the label;
    rounds needed grow with the logarithm of a component's width. The edges of a hub and the
    nodes of a large component are not gathered in one task. Edges never leave the cluster; the driver
    sees a few numbers a round, and the names of hubs and components with a thousandth of all rows.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = saved(both.union(both.select("other", "node")).where("node <> other").distinct(), "edges")
    labels = saved(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    held = labels
    while True:
        near = join_one(both, labels, ["node"]).groupBy("other").agg(F.min("label").alias("near")).withColumnRenamed("other", "node")
        step = saved(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "step")
        far = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = saved(join_one(step, far, ["label"]).select("node", F.least("label", "far").alias("label"), "was"), "labels")
        changed = new.where("label <> was").limit(1).count()
        discard(step)
        discard(held)
        held, labels = new, new.select("node", "label")
        if not changed:
            discard(both)
            return labels
