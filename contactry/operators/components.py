"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) for every node of ``edges`` (src, dst); label is the smallest node of its component.

    Alternates two star steps over the edge table: every node's larger neighbours are tied to the smallest node
    around it, then its smaller ones are. Components become stars in a number of rounds that grows with the
    logarithm of their size, also for long chains; the neighbour minimum is a pre-aggregated grouping, so a hub
    is no single task. ``save`` stores a round's edges (a checkpoint or a written table) to cut the lineage.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    current = save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    now = sign(current)
    while now[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = save(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        current = save(small.where("a > b").distinct())
        before, now = now, sign(current)
        if now == before:
            break
    stars = current.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return ends.select(F.col("a").alias("node")).distinct().join(stars, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
