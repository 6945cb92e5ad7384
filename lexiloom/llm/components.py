"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """v and root (the least id of its component) for the ends a, b of all edges; no edges give no rows.

    Each round every label that has edges takes the least label beside it, and then that one's; the edges then join the
    new labels, and those within one label go. Rounds go on until no edge is left. While one is, its larger label takes
    another, and the least label of a component keeps its own, so this ends with one label for each component.
    Labels move with all their members, and not a hop a round. Labels and edges are written each round;
    nothing is gathered at one place.
    """
    given = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    given = materialise(given, "edges")
    labels = materialise(given.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("root", F.col("v")), "labels")
    left = given.where("a < b")
    while not left.isEmpty():
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        near = materialise(near.select(F.col("a").alias("old"), F.least("a", "b").alias("next")), "hooks")
        after = near.select(F.col("old").alias("at"), F.col("next").alias("new"))
        moved = materialise(near.join(after, near.next == after["at"]).select("old", "new"), "hooks")
        labels = labels.join(moved, labels.root == moved.old, "left").select("v", F.coalesce("new", "root").alias("root"))
        labels = materialise(labels, "labels")
        left = left.join(moved, left.a == moved.old).select(F.col("new").alias("a"), "b")
        left = left.join(moved, left.b == moved.old).select(F.least("a", "new").alias("a"), F.greatest("a", "new").alias("b"))
        left = materialise(left.where("a < b").distinct(), "edges")
    return labels
