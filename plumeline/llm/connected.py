"""Connected components by contraction: hook every node to its smallest neighbour, halve paths, relabel edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.llm.common import stage, unstage


def _halved(parent: DataFrame) -> DataFrame:
    """node -> root for a forest of node -> parent, in a number of joins logarithmic in its depth."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        jumped = stage(parent.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")), "jump")
        unstage(parent)
        parent = jumped.select("node", "parent")
        parent._staged_at = jumped._staged_at
        if jumped.filter("_moved").isEmpty():
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of long ids -> (node, root); root is the smallest id of the component.

    Nodes that are their own root are left out, so callers take coalesce(root, node). Self loops and repeated
    edges are allowed; no edges give no rows. Every round only aggregates and joins on keys: no group of
    neighbours is ever collected, so a hub with a third of all edges is pre-aggregated before the shuffle.
    """
    left = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    left_at = left
    labels: DataFrame | None = None
    labels_at: list[DataFrame] = []
    while not left.isEmpty():
        parent = _halved(stage(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hook"))
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("root"))
        else:
            moved = parent.select(F.col("node").alias("root"), F.col("parent").alias("_to"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
            labels = labels.unionByName(parent.select("node", F.col("parent").alias("root")))
        labels, before = stage(labels, "labels"), labels_at
        unstage(*before)
        labels_at = [labels]
        to_a, to_b = parent.toDF("a", "_a"), parent.toDF("b", "_b")
        left = left.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        before = left_at
        left = left_at = stage(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        unstage(before, parent)
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
