"""Connected components of links, by alternating large and small stars; nothing reaches the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node of its component.

    Each round gives every node's larger neighbours, then its smaller ones, to its least neighbour.
    Hubs are never gathered: a star is a partial aggregation and a join, whose hot keys Spark can split.
    Rounds grow with the logarithm of the component's size; each is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = materialize(now, "links")
    last = None
    while True:
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if told == last or not told["n"]:
            return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root"))).distinct()
        last = told
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = materialize(least, "least")  # as a stored side, so that Spark can split a hub's rows
        large = both.join(least, a == F.col("u")).where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        least = materialize(least, "least")
        small = large.join(least, a == F.col("u")).where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialize(small, "small-star")
