"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """v, c for each end of edges (a, b): c is the smallest vertex that v is connected to.

    Each round takes the smallest label of the neighbours and then the label of that label, so that rounds grow with the
    logarithm of the longest path. Labels are written tables; the driver sees one count a round.
    """
    ends = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(ends.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c")), "labels")
    while True:
        near = ends.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("before"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        after = written(lower.join(up, "c").select("v", "before", F.least("c", "up").alias("c")), "labels")
        labels = after.select("v", "c")
        if after.where("c <> before").isEmpty():
            return labels
