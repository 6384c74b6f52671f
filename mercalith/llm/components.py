"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a few joins and aggregates over the link table, which is written to the shared folder
between rounds, so lineage stays short and lost executors cost one round.  The number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercalith.llm.common import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of each u and its neighbours v; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    joined = both.filter("v > u").join(_smallest(both), "u")
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; a < b in every link."""
    down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    low = _smallest(down)
    joined = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = low.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return joined.union(own).filter("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node of its component.

    Direction and repeats of links do not matter, links from a node to itself are ignored, links
    with NULL too.  Nodes that are in no link are not listed.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = stored(ordered.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        now = stored(_small_star(_large_star(now)), "links")
        # links are ordered pairs without repeats: count and hash sum tell whether they changed
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                now.select("a", "a").distinct()
            )
        state = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
