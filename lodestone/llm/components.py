"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and minima over the edge table; nothing is gathered on the driver, and no vertex's
neighbours are gathered in a task: minima are combined before the shuffle, and the join that carries them back to a
vertex of many edges can be split by adaptive execution. The joins are hinted to be sort-merge joins, so that no side
that grows with the input passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _finished(edges: DataFrame) -> bool:
    """Whether the edges are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return seen.where("up > 1 OR up > 0 AND down > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (u, v: long); component is the smallest vertex reachable."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = runtime.cut(edges)
    while not _finished(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = runtime.cut(small.select("e.u", "e.v").where("u <> v").distinct())
    roots = edges.select(F.col("v"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component")).union(roots)
