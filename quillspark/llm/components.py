"""Connected components of a distributed edge list, by alternating large and small stars.

Each round rewires edges to the least neighbour, so edges never multiply and chains shorten by halves. Neighbours' minima
are combined before they move; a node with very many neighbours is a large key of an equi-join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star, over edges (a, b) with a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that Spark may split the join below at a node with very many neighbours (not straight after an aggregate).
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least", few=True)
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # Edges from the larger end keep their least: (a, m) for each a with smaller neighbours.
    rest = least.filter("m < a").select("a", F.col("m").alias("b"))
    large = written(large.unionByName(rest).filter("a <> b").distinct(), "stars", few=True)
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
    return small.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node of the edges (a, b); loops and repeated edges do no harm."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars", few=True)
    mark = None
    for _ in range(rounds):
        now = written(_star(now), "stars", few=True)
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if said == mark:
            break
        mark = said
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
