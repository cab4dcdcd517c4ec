"""Connected components of a graph of longs, by alternating large-star and small-star steps.

Every step is a grouping with partial aggregation and joins of two freshly shuffled tables, so a
vertex with very many links is split over tasks. One table is written for each pair of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeflow.llm.common import stored


def _both_ways(edges: DataFrame, u: str = "u", v: str = "v", m: str = "v") -> DataFrame:
    """For each row the edges (u, v) and (v, u); or, with ``m``, (u, m) and (v, m)."""
    second = F.struct(F.col(v).alias("u"), F.col(u if m == v else m).alias("v"))
    pair = F.array(F.struct(F.col(u).alias("u"), F.col(m).alias("v")), second)
    return edges.select(F.explode(pair).alias("e")).select("e.u", "e.v")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every vertex has one link upwards, or only links from below (u > v, no repeats)."""
    role = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"))))
    roles = edges.select(role.alias("r")).groupBy("r.x").agg(F.sum("r.up").alias("up"), F.min("r.up").alias("low"))
    return roles.where("up > 1 or (up = 1 and low = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of each vertex of ``edges(u, v)`` except the smallest of its component.

    ``component`` is the smallest vertex that can be reached. Loops and repeated edges are fine.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    current = stored(edges.where("u <> v").select(big.alias("u"), small.alias("v")).distinct(), "cc-edges")
    while not _is_forest_of_stars(current):
        both = _both_ways(current)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        current = stored(_both_ways(large.join(lowest, "u"), m="m").where("u <> v").distinct(), "cc-edges")
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
