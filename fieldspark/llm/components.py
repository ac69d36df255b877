"""Connected components of an edge table, by alternating large and small stars.

Every step is a grouped minimum and a join on the node; neither a node's neighbours nor a component
are ever collected.  The minima combine map-side and are written before the join, so both of its
sides are plain exchanges and the engine may split a hub's rows over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return _replaced(moved, least, edges)


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _replaced(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), least, edges)


def _replaced(new: DataFrame, *old: DataFrame) -> DataFrame:
    """``new``, written; the tables it came from are deleted."""
    out = written(new, "edges")
    dropped(*old)
    return out


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points to one root and no root points on."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = sides.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node that has an edge; no edges, no rows."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_stars(edges):  # each round shortens the paths; stars are the fixed point
        edges = _small_star(_large_star(edges))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return _replaced(stars.unionByName(roots), edges)
