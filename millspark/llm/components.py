"""Connected components of a graph by label propagation, in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millspark.session import staged


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, component`` for the nodes of ``links`` (``a``, ``b``, both long): the smallest node each can reach.

    Every round takes the smallest label among neighbours and then the label of that label, so a path halves per round;
    each round is written to the shared folder, which cuts lineage. Ends when nothing changes. A hot node costs one row
    per link, combined before the shuffle. Raises if ``rounds`` do not suffice; a partial labelling is never returned.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = staged(step.join(jump, step["next"] == jump["via"], "left").select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "label"))
        changed = step.filter(F.col("next") != F.col("label")).limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components not settled after {rounds} rounds")
