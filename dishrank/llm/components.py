"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop, staged


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the smallest node names it.

    Each round takes the smallest name among a node's neighbours and then that name's
    own, so long chains shorten by half a round. Rounds are written tables; only the
    number of changes reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = staged(both.where("a <> b").distinct(), "links")
    labels = staged(
        links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")),
        "labels",
    )
    written = labels
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        taken = labels.join(least, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "seen").alias("component")
        )
        names = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = taken.join(names, "component", "left").select(
            "node", "before", F.least("component", "further").alias("component")
        )
        after = staged(jumped, "labels")
        drop(written)
        written = after
        changed = after.where("before <> component").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            drop(links)
            return labels
