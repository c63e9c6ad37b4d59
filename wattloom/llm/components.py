"""Connected components of a graph too large for one machine, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame) -> DataFrame:
    """Join every pair (u, v) with the least node around u.

    The minima are written first: the join then reads both sides from plain exchanges, and a node with very many
    edges is split over tasks.
    """
    least = written(
        pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star"
    )
    return pairs.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node in ``edges`` (columns ``a``, ``b``; integers).

    A round replaces edges by shorter ones to the least node nearby; the number of rounds grows with the logarithm
    of the longest path, and each round ends in a written table.
    """
    now = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        large = _star(_both(now)).filter("b > a").select(F.col("m").alias("a"), F.col("b"))
        large = written(large.distinct(), "edges")
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        small = _star(down)
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        then = written(small.filter("a <> b").distinct(), "edges")
        changed = then.exceptAll(now).limit(1).count()
        if not changed and then.count() == now.count():
            return then.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                then.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        now = then
