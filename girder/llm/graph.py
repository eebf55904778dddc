"""Connected components by minimum labels with pointer jumping, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) for every node of edges (a, b: long).

    Each round passes labels along the edges in both directions, to the nodes and to the nodes that are their labels,
    and then replaces every label by its own label, so that what hangs together moves at once. Edges may repeat and may be loops; nulls are left out. Tables
    of every round are written to the shared folder. Only whether labels have changed reaches the driver.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = keep(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        told = both.join(labels, F.col("a") == F.col("node")).select("b", "label").groupBy("b").agg(F.min("label").alias("label"))
        own = labels.select(F.col("node").alias("b"), F.col("label").alias("own"))
        told = told.join(own, "b").where("label < own").select(F.explode(F.array("b", "own")).alias("node"), "label")
        heard = keep(told.unionAll(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")), "labels-heard")
        jump = heard.select(F.col("node").alias("to"), F.col("label").alias("further"))
        before, labels = labels, keep(heard.join(jump, F.col("label") == F.col("to")).select("node", F.least("label", "further").alias("label")), "labels")
        settled = labels.join(before.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty()
        discard(heard, before)
        if settled:
            discard(both)
            return labels
