"""Connected components of a table of links, without links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.sources.stages import materialize


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the smallest node reachable.

    Every round takes the smallest label among the neighbours and then the label of that label, so paths halve.
    """
    ways = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    labels = materialize(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = (
            ways.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        stepped = lower.join(jump, "low", "left")
        stepped = materialize(stepped.select("node", F.col("root").alias("was"), F.least("low", "beyond").alias("root")))
        labels = stepped.select("node", "root")
        if stepped.where("was != root").isEmpty():
            return labels
