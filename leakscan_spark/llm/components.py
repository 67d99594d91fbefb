"""Connected components of a link table by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node in ``links`` (a, b).

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so chains halve. Nothing is collected but a count of
    changed labels.
    """
    both = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        least = saved(least, "labels")
        up = least.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        renewed = least.join(up, F.col("label") == F.col("up"), "left").select(
            "node", "was", F.least("label", "up_label").alias("label")
        )
        renewed = saved(renewed, "labels")
        labels = renewed.select("node", "label")
        if renewed.where(F.col("label") != F.col("was")).isEmpty():
            return labels
