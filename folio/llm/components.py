"""Connected components of an edge table by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, label)`` for the nodes of ``edges(a, b)``; label is the smallest node reached.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so paths shorten by doubling.  Labels are written to the shared folder after each
    round (no lineage to recompute when an executor is lost); only a count of changed labels
    reaches the driver.  An empty edge table gives an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = materialize(both, f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), f"{name}-labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a").agg(F.min("label").alias("best"))
        )
        hooked = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "best").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        fresh = hooked.join(up, "low", "left").select(
            "node", F.least("low", "above").alias("label"), (F.least("low", "above") != F.col("label")).alias("moved")
        )
        fresh = materialize(fresh, f"{name}-labels")
        labels = fresh.select("node", "label")
        if not fresh.where("moved").limit(1).count():
            return labels
