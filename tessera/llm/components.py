"""Connected components of an edge table by alternating large and small stars; no step collects links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import loose
from .common import written


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (x, y) with m, the least of x and its neighbours. The minima join without their partitioning, so that Spark may
    split the join where one x has very many neighbours."""
    least = loose(pairs.groupBy("x").agg(F.min("y").alias("m")))
    return pairs.join(least, "x").withColumn("m", F.least("x", "m"))


def _settled(now: DataFrame) -> bool:
    """Whether every x has one y and no y is an x: then each component is a star around its least id, which no round changes."""
    ends = now.select(F.col("x").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select(F.col("y"), F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) for every id of edges (u, v). Repeated, reversed and self edges do no harm; edges
    with a null end are ignored; no edges give no rows.

    Each round joins every larger neighbour to the least of a neighbourhood, then every smaller one, which halves the
    distance to the component's least id; it ends when only stars are left, which is tested exactly, after O(log^2 n) rounds at most.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct(), "edges")
    while not _settled(now):
        both = now.union(now.select("y", "x"))
        large = written(_star(both).filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct(), "large")
        small = _star(large)
        now = written(small.select("x", F.col("m").alias("y")).union(small.filter("y <> m").select("y", "m")).distinct(), "small")
    return now.select(F.col("x").alias("id"), F.col("y").alias("component")).union(now.select("y", "y").distinct())
