"""Connected components of an undirected graph of integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for all nodes of links(a, b).

    Labels fall by the smallest label of the neighbours and by the label of the
    label, round by round, until none changes. Each round is a written table,
    and no more than one number comes to the driver. No links: no rows.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("a", "b"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        fallen = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = cut(fallen.join(of_label, "label", "left").select("node", "was", F.least("label", "jump").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> was").limit(1).count() == 0:
            return labels
