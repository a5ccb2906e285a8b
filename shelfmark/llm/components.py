"""Connected components of a table of links, by joins; labels move along links and along labels, so chains of any length
take a number of rounds that grows as its logarithm. State is cut by checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """node, label (the smallest node reachable) of all nodes of `links` (a, b). Null ends are no links; no links, no rows.
    `parts`: files at most of what a round writes."""
    one_way = links.select("a", "b").where("a <> b")
    both = cut(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), parts)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), parts)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("lb"))
        own = near.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        moves = own.select(F.col("a").alias("node"), F.least("la", "lb").alias("label")).unionByName(own.select(F.col("la").alias("node"), F.least("la", "lb").alias("label")))
        hooked = cut(moves.groupBy("node").agg(F.min("label").alias("label")), parts)
        jumped = hooked.alias("x").join(hooked.alias("y"), F.col("x.label") == F.col("y.node")).select("x.node", F.col("y.label").alias("label"))
        after = cut(jumped, parts)
        if after.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty():
            return after
        labels = after
