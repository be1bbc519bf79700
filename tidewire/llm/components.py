"""Connected components by alternating star contraction, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.frames import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of ``links`` (columns ``a``, ``b``).

    Each round points every larger neighbour of a node to the node's smallest neighbour, then every node's smaller
    neighbours likewise, until all links are stars. A round keeps at most as many links as there were, and the
    number of rounds grows with the logarithm of the longest chain. Minima are combined within tasks, and a node
    with very many links is only ever the key of an aggregation or of a join that can be split.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", links.count())
    while True:
        most = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("a", "low").alias("low"))
        large = both.join(low, both.a == low.of).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star", most)
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "of")
        to_low = large.join(low, large.a == low.of).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small_ = written(to_low.unionByName(low.select(F.col("of").alias("a"), F.col("low").alias("b"))).distinct(), "small-star", most)
        # all stars: no end of a link is the begin of another, and no node has two
        begins = small_.select(F.col("a").alias("node"), F.lit(1).alias("begins")).unionByName(small_.select(F.col("b").alias("node"), F.lit(0).alias("begins")))
        seen = begins.groupBy("node").agg(F.sum("begins").alias("begins"), F.min("begins").alias("least"))
        if not seen.where("begins > 1 or begins = 1 and least = 0").limit(1).count():
            roots = small_.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return written(small_.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components", most)
        edges = small_
