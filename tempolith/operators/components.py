"""Connected components of an edge table, by hooking labels to labels and shortening their ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable. ``keep`` writes a frame where executors can read it again.

    In a round, each node looks at the labels of its neighbours' labels, and takes the least; the node that was its
    label takes it, too. So whole groups of nodes meet at once, where one of them has a neighbour outside, and stars,
    chains and rings of n nodes end after about log n rounds, whatever the order of their ids. Labels only fall, and
    rounds end when none does. Labels are combined before the shuffle, so a node with very many edges is no hot key.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    both = keep(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("top"))
        tops = labels.join(jump, labels.label == jump["at"]).select("node", "label", "top")
        near = both.join(tops, both.b == tops.node).groupBy("a").agg(F.min("top").alias("near"))
        least = tops.join(near, tops.node == near.a).select("node", "label", F.least("top", "near").alias("to"))
        moves = least.select("node", "to", F.col("label").alias("old")).unionByName(least.groupBy(F.col("label").alias("node")).agg(F.min("to").alias("to")).select("node", "to", F.lit(None).cast(labels.schema["label"].dataType).alias("old")))
        new = keep(moves.groupBy("node").agg(F.min("to").alias("label"), F.max("old").alias("old")), "labels")
        labels = new.select("node", "label")
        if not new.filter("old <> label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
