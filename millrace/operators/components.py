"""Connected components of a link table, by rounds of joins; no part of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in ``links``, the component named by its smallest node.

    Each round a node takes the smallest label among its neighbours and then
    that label's own label, so paths shorten exponentially. Labels are written
    to the shared folder each round. Self-links and repeated links do no harm;
    an empty table gives no rows.
    """
    edges = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).where(F.col("x").isNotNull() & F.col("y").isNotNull()).distinct(), "edges")
    labels = written(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"), "labels")
    while True:  # labels only ever fall, so this ends
        near = edges.join(labels.select(F.col("node").alias("y"), F.col("label").alias("_l")), "y").groupBy(F.col("x").alias("node")).agg(F.min("_l").alias("_n"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "_n").alias("_m"))
        jump = labels.select(F.col("node").alias("_m"), F.col("label").alias("_j"))
        new = written(step.join(jump, "_m", "left").select("node", F.col("label").alias("_old"), F.least("_m", F.coalesce("_j", "_m")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("_old") != F.col("label")).isEmpty():
            return labels.withColumnRenamed("label", "component")
