"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut, release


def components(links: DataFrame) -> DataFrame:
    """Return (node, label) of every node of the undirected ``links`` (a, b); label is its component's least node.

    Each round a node takes the least of its label, the labels around it and its label's label, so chains shorten by
    half. Rounds end when no label changes. Every round is one written table, whose write also counts the changes;
    nothing else comes to the driver.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("label").alias("next"))
        above = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", "next")
        seen = around.unionByName(above).groupBy("node").agg(F.min("next").alias("next"))
        changes = Observation()
        after = labels.join(seen, "node").select("node", F.least("label", "next").alias("label"), (F.col("next") < F.col("label")).alias("changed"))
        before, labels = labels, cut(after.observe(changes, F.count_if("changed").alias("n")).select("node", "label"), "labels")
        release(before)
        if not changes.get["n"]:
            release(both)
            return labels
