"""Connected components by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of ``edges`` (a long, b long): label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of that
    label; its lineage ends in a table in the shared folder.  Labels are summed up before
    each shuffle, so a node with very many links is no single task's load.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        # a table rather than a checkpoint: plans over checkpoints carry all earlier rounds' constraints along
        new = written(lower.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        dropped(labels)
        labels = new.select("node", "label")
        if new.filter("label <> was").isEmpty():
            dropped(both)
            return labels
