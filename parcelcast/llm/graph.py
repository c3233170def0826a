"""Connected components by repeated joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelcast.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Every round takes the smallest label among a node's neighbours and then the label of that label, so paths shrink
    to a fraction. Hot labels meet a table with one row for each node, a join that adaptive execution can split.
    """
    edges = edges.where("a <> b")
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = written(step.join(up, "label").select("node", "old", F.least("label", "top").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
