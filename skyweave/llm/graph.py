"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.session import cut_lineage


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``, longs) but the roots.

    The root is the smallest node of the component.  Each round writes the
    rewired edges to the shared folder; the loop ends when a round changes
    nothing.  Minima are formed before the shuffle, so the centre of a large
    star is no hot key there.
    """
    current, seen = cut_lineage(_down(edges)), None
    while True:
        check = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (check.n, check.h) == seen or not check.n:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (check.n, check.h)
        current = cut_lineage(_small_star(_large_star(current).distinct()).distinct())
