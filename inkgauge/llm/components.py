"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """``node, class_id`` of every end of a link ``a, b``; the class is its smallest node.

    Each round takes the smallest class among a node and its neighbours, then the
    class of that class, and is written; rounds end when nothing changes.  A node
    with very many links is pre-aggregated where its links lie.  No link, no row.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a is not null and b is not null and a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("class_id")), "labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("class_id").alias("least"))
        )
        lower = labels.join(near, "node").select("node", "class_id", F.least("class_id", "least").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("class_id").alias("further"))
        lower = written(
            lower.join(jump, "to").select("node", F.least("to", "further").alias("class_id"), (F.col("class_id") != F.least("to", "further")).alias("changed")),
            "labels",
        )
        labels = lower.select("node", "class_id")
        if lower.where("changed").isEmpty():
            return labels
