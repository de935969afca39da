"""Connected components by label propagation with pointer jumping, on tables in the cluster only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges`` (a, b): label is the smallest node that it reaches.

    A round moves each label along the edges and then replaces it by its own label, so a path of n
    nodes takes about log n rounds. Labels sit on one side of a join whose other side holds a hub's
    edges, and both sides are dealt for the join alone, so a hub's rows can be split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    steps = checkpointed(both.union(nodes.select("a", F.col("a").alias("b"))).distinct())
    labels = steps.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id")
    labels = checkpointed(labels)
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("label").alias("near"))
        moved = steps.join(seen, "b").groupBy("a").agg(F.min("near").alias("label"), F.min(F.when(F.col("a") == F.col("b"), F.col("near"))).alias("old"))
        heads = labels.select(F.col("id").alias("head"), F.col("label").alias("further"))
        jumped = moved.join(heads, moved["label"] == heads["head"]).select(F.col("a").alias("id"), F.least("label", "further").alias("label"), "old")
        jumped = checkpointed(jumped)
        if jumped.where("label <> old").isEmpty():
            return jumped.select("id", "label")
        labels = jumped.select("id", "label")
