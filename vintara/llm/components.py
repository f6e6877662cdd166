"""Connected components of a graph given as links between integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for rows (a, b): component is the smallest node that can be reached.

    Each round gives a node the smallest label among itself and its neighbours and then the label of that label, so
    labels travel along ever longer paths. A minimum per node is summed up before the shuffle, so a node with very many
    links does no harm. Every round's labels are written, those of the round before deleted, and rounds end when none has
    changed.
    """
    both = links.select("a", "b").where("a != b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    jumped = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    labels = jumped
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("next"))
        met = materialize(met, "met")
        discard(jumped)
        far = met.select(F.col("node").alias("at"), F.col("next").alias("further"))
        jumped = met.join(far, met["next"] == far["at"]).select("node", "component", F.least("next", "further").alias("next"))
        jumped = materialize(jumped, "jumped")
        discard(met)
        labels = jumped.select("node", F.col("next").alias("component"))
        if not jumped.where("next != component").limit(1).count():
            return labels
