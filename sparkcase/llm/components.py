"""Connected components of an edge table, by alternating large and small stars.

Every round is two joins and minima over edges; rounds are written to the
shared folder, and nothing but a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    down = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "down")
    least = _least(down)
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")
    return written(near.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "stars")


def _checksum(edges: DataFrame) -> tuple:
    parts = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(parts.cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge and is not the least of its component, with that least node."""
    now = _small_star(edges)
    before, after = None, _checksum(now)
    while before != after:
        now = _small_star(_large_star(now))
        before, after = after, _checksum(now)
    return now
