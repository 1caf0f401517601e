"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.runtime import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `links` (a, b longs); label is the smallest node reachable.

    Each round takes the least label among a node's neighbours, then the label of that label; rounds end when no
    label changes, and each is written, so that a lost executor costs one round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("least"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("top"))
        after = least.join(roots, least["least"] == roots["root"], "left")
        after = after.select("node", F.least("least", F.coalesce("top", "least")).alias("new"), "label")
        after = written(after, "labels")
        moved = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not moved:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
