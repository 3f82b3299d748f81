"""Connected components of a table of links, by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.sources import stored


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Stored ``pairs`` (a, b) with ``least``, the smallest b of the same a.

    Both sides of the join are stored tables, so a node with very many neighbours is split at run time.
    """
    return pairs.join(stored(pairs.groupBy("a").agg(F.min("b").alias("least"))), "a")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node reachable.

    Each round hangs neighbours under their smallest one, first the larger neighbours of every
    node, then the smaller ones; the number of rounds grows with the logarithm of the longest path.
    Every round is stored, so that a lost executor costs one round.
    """
    pairs = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # Done when every node hangs under one other, and that one under none.
        ends = pairs.select("a", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            pairs.select(F.col("b").alias("a"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        )
        tangled = ends.groupBy("a").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if tangled.filter("below > 1 or below = 1 and above = 1").isEmpty():
            roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        larger = _least_neighbour(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        # One row for each of ``pairs`` at most: equal ones are merged once, at the end of the round.
        smaller = stored(_least_neighbour(stored(larger.filter("a <> b"))))
        hung = smaller.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        pairs = stored(hung.unionByName(smaller.select("a", F.col("least").alias("b"))).distinct())
