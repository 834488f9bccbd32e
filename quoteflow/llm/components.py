"""Connected components of links, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _lowest(pairs: DataFrame) -> DataFrame:
    """Per ``a``: the smallest of itself and its ``b``."""
    return pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Every node's neighbours hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else down
    met = pairs.join(_lowest(pairs), "a")
    if both_ways:
        hung = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        hung = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            met.select("a", F.col("low").alias("b"))
        )
    return hung.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links to ``node, root``: the smallest node of each component with more than one node.

    The rounds grow with the logarithm of the longest path.  Each round is written, so none is done twice.
    """
    edges = keep(links.where("a != b").select("a", "b").distinct(), "edges")
    # the rounds hang nodes on other nodes and add no edges to speak of; this only says how many files they may fill
    most, mark = 3 * edges.count(), None
    while True:
        edges = keep(_star(keep(_star(edges, True), "large-star", most), False), "small-star", most)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
