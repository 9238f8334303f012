"""Connected components of a graph by least labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.session import staged


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the least node of its component. nodes: node; links: a, b.

    Only linked nodes take part in the rounds. Each round takes the least label among neighbours and then the
    label of that label, so chains shorten by half; every round's labels are staged.
    """
    ends = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    labels = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = staged(labels, "labels")
    while True:
        near = ends.join(labels.withColumnsRenamed({"node": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("label", "l").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was")
        new = staged(new, "labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
