"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import cut

#: Labels are broadcast up to so many nodes.
BROADCAST_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then that node's label; rounds are
    written to the checkpoint folder, so that lineage stays short and lost executors cost one round at most. Labels only
    get smaller, so that the rounds end, after about the logarithm of the longest way. The labels (two numbers each) are
    broadcast up to BROADCAST_ROWS nodes and shuffled beyond."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    small = labels.count() <= BROADCAST_ROWS
    while True:
        sent = F.broadcast(labels) if small else labels
        known = lambda node, label, sent=sent: sent.select(F.col("node").alias(node), F.col("label").alias(label))
        near = both.join(known("v", "near"), "v").groupBy("u").agg(F.min("near").alias("near"))
        step = near.join(known("u", "label"), "u").select("u", "label", F.least("label", "near").alias("next"))
        moved = cut(step.join(known("next", "jump"), "next").select(F.col("u").alias("node"), "label", F.least("jump", "next").alias("next")))
        labels = moved.select("node", F.col("next").alias("label"))
        if not moved.filter("label <> next").take(1):
            return labels
