"""Connected components of an edge table, without gathering edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import drop, materialize


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of ``edges`` (columns a, b, of one type).

    Smallest labels spread along edges and then to the labels' own labels, which halves what is left of long paths, so
    the number of rounds grows with the logarithm of a component's length. Nodes of many edges are joined, not grouped.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = materialize(spark, both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    last = labels = materialize(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        spread = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        new = materialize(spark, spread.join(hop, "label", "left").select("node", "old", F.least("label", "hop").alias("label")), "labels")
        drop(spark, last)
        last, labels = new, new.select("node", "label")
        if new.where("old <> label").isEmpty():
            drop(spark, both)
            return labels
