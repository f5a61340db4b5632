"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import checkpoint


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that ``links`` (``a``, ``b``) names.

    Each round hangs neighbours below the smallest node in sight. Smallest neighbours are found by an aggregate and
    joined back, so a node with very many neighbours is split like any skewed join. Rounds grow with the logarithm
    of the longest path. Each round is cut off with a checkpoint.
    """
    pairs = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = _state(pairs)
    while True:
        # Large star: every larger neighbour of a node goes below the smallest in its neighbourhood.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpoint(large.where("a > b").distinct())
        # Small star: a node and its smaller neighbours go below the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        pairs = checkpoint(small.where("a > b").distinct())
        now = _state(pairs)
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
