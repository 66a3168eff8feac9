"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import growing, settle


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least one."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.where("b > a")
    return larger.join(growing(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them.
    links hold the larger node in a."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(growing(least), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def least_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): the least node that it
    reaches. Nodes are longs; self links and null ends are ignored.

    Each round is two merge joins on unique per-node minima, whose link side Spark
    may split when a node is hot and of which neither is broadcast, as files of
    links are far smaller than links in memory; a round's links are written to the shared folder,
    so that a lost executor costs a re-read. Rounds end when links repeat: about
    the logarithm of the longest path. No link reaches the driver."""
    current = settle(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        mark = tuple(
            current.agg(
                F.count("*"),
                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            ).first()
        )
        if mark == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
        current = settle(_small_star(_large_star(current)), "links")
