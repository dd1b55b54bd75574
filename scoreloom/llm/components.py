"""Connected components of a graph of links, by hashing to the least neighbour with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for every node that has a link to another.

    Alternates: every neighbour that is larger than a node goes to the node's least neighbour; then every
    neighbour that is smaller goes to it. Both keep what is reachable, and end as stars around the least nodes after
    a number of rounds that grows with the logarithm of the longest path.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # neighbours above a node
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # every edge of `large` points down
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # done once nothing but stars is left: no node is both above one and below another
        if not after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            if not after.groupBy("a").count().where("count > 1").limit(1).count():
                return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = after
