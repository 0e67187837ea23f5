"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.session import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every upper end has one edge and no node is both an upper and a lower end."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up + low > 1 and up > 0").isEmpty()


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge with the least node it reaches.

    Each round points the neighbours of a node at the least one of them, first the larger
    neighbours, then the smaller; every component becomes one star in a logarithmic number
    of rounds. A hub's edges meet its least neighbour in a join, which splits when skewed,
    and the least neighbour is combined map-side, so no task holds a hub's neighbours.
    Self edges and null ends are ignored.
    """
    a, b = F.col(src), F.col(dst)
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "edges", thin=True)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(materialize(large, "edges", thin=True))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.select(F.inline(pairs)).where("u != v").distinct(), "edges", thin=True)
        if _are_stars(edges):
            break
    least = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
