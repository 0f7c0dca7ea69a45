"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decoylog.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("m").alias("a"), "b")
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    linked = down.join(least, "n")
    return (
        linked.select(F.col("m").alias("a"), F.col("s").alias("b"))
        .union(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any orderable type gives (node, root): root is the least node.

    Each round writes the contracted links to the shared folder; rounds grow with
    the logarithm of the longest chain.  Nodes without links do not appear.
    """
    edges = cut(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    while True:
        turned = cut(_small_star(_large_star(edges)))
        state = lambda e: e.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state(turned) == state(edges):
            break
        edges = turned
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
