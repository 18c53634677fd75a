"""Connected components of links between 64-bit class numbers, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node that links ``a``-``b`` lead to, for every node of a link.

    Each round takes the least label among a node and its neighbours, then the label of that
    label; labels settle after about log2 of the longest path. Equal pairs, pairs of a node
    with itself and an empty table are allowed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.table(both.distinct())
    labels = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("near"))
        least = labels.join(near, F.col("node") == F.col("n")).select("node", "root", F.least("root", "near").alias("least"))
        jump = labels.select(F.col("node").alias("j"), F.col("root").alias("far"))
        settled = least.join(jump, F.col("least") == F.col("j")).select("node", F.col("root").alias("before"), F.least("least", "far").alias("root"))
        settled = scratch.table(settled)
        labels = settled.select("node", "root")
        if settled.filter("root <> before").isEmpty():
            return labels
