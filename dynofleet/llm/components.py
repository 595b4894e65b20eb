"""Connected components of an edge table, as label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of ``edges`` (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label; rounds end when no label changes. Labels are written tables; nothing is collected but
    the number of changes. No edges: no rows.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = stored(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("component")))
        changed = new.filter("component < old").limit(1).count()
        forget(labels)
        labels = new
        if not changed:
            forget(both)
            return labels.select("node", "component")
