"""Connected components of a link table by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest one around it, small-star does the same for the
smaller neighbours; alternating them ends in one star per component after a number of rounds logarithmic in the
largest component. Each round is an aggregation with map-side combine and a plain join on stored tables, whose skewed
partitions adaptive execution splits, so the hub of a large star is no one task's load. Nothing reaches the driver but
whether another round is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import stage


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one smaller node at most, and only on one that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(_flipped(edges))
    least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large-star")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger to the smaller node."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``: the component is its smallest node.

    Loops, repeated links and links with a null end are ignored; an empty table gives an empty result.
    """
    a, b = F.col(links.columns[0]), F.col(links.columns[1])
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stage(edges.distinct(), "links")
    while not _is_stars(edges):
        large = stage(_large_star(edges).distinct(), "stars")
        edges = stage(_small_star(large).distinct(), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
