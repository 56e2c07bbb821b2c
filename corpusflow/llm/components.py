"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``edges`` (longs ``a``, ``b``); the label is the least node of the component.

    Each round every node takes the least label among its neighbours and its own, then the label of that label, so
    that chains shorten by jumping. Labels meet in aggregates that combine before the shuffle, and both sides of each
    join are stored tables, so that a node with very many neighbours is split over tasks. Ends when nothing changes.
    """
    both = staged(
        edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "edges"
    )
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        least = staged(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")),
            "least",
        )
        jumped = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = staged(
            least.join(jumped, "label").select("node", F.least("label", "further").alias("label"), "old"), "jumped"
        )
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return labels
