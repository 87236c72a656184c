"""Connected components of a graph whose links are rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import stage


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, itself included; summed up before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("m")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_smallest(both), F.col("u") == F.col("node"))
    return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = down.join(_smallest(down), F.col("u") == F.col("node"))
    to_own = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_own.union(near.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that is not its own root.

    Each round writes its links, so a lost executor costs tasks of one round.  The rounds grow
    with the logarithm of the longest chain.  Stars of any size are joined and grouped, never
    collected; the grouping sums up before it shuffles.
    """
    edges = stage(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        now = edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)
        ).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        starred = stage(_large_star(edges).distinct(), "large-star")
        edges = stage(
            _small_star(starred).where(F.col("u") != F.col("v")).distinct(), "small-star"
        )
