"""Connected components of links that a table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links (a, b) lead to, for every node of a link.

    Each round a node takes the least label of its neighbours, then the label of that label,
    so chains shrink by more than half. Rounds are stored and end when no label changes.
    """
    both = stored(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(
            lower.join(jump, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
            ),
            "labels",
        )
        labels = new.select("node", "label")
        if new.filter("label < old").isEmpty():
            return labels
