"""Connected components of a graph given by its links, by alternating large and small stars.

Each round is two aggregations and two joins whose results are written to the shared folder, so
a lost executor costs at most a round. The rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least among itself and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where("b > a")
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these; ``a > b`` in every link."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: each linked node (roots included) with the least node of its component.

    ``links`` has two long columns ``a`` and ``b``; loops, repeats and nulls are ignored.
    """
    current = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(current)
    for _ in range(MOST_ROUNDS):
        if state[0] == 0:
            break
        current = stage(_small_star(_large_star(current)))
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return row["n"], row["s"]
