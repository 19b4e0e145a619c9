"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node.

    Alternates large and small stars (Kiveris et al., 2014): in each round every
    node hooks its larger, then its smaller neighbours to the least one it
    knows, until only stars around each component's least node are left. Rounds
    grow with the logarithm of the longest path. Every round is an aggregate
    and an equality join, and is checkpointed to the shared folder; nothing but
    a row count and a checksum reaches the driver. Self-links are ignored;
    an empty graph gives no rows.
    """
    stars = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = _signature(stars)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        stars = _small_star(_large_star(stars)).checkpoint()
        after = _signature(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    hubs = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        hubs.select("node", F.col("node").alias("component"))
    )


def _signature(stars: DataFrame) -> tuple:
    row = stars.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))
    ).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge already points from the larger node a to the smaller node b.
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
