"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.session import materialise, scratch_path


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node points to one root at most, and no root points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or no larger) neighbours to the smallest node around it.

    The smallest is found by an aggregate that combines before the shuffle, so a node with
    very many neighbours is never gathered in one task.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("_least"))
        linked = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("_least", "a").alias("b"))
    else:
        # Edges point from the larger node to the smaller one.
        least = edges.groupBy("a").agg(F.min("b").alias("_least"))
        found = edges.join(least, "a")
        linked = found.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionByName(
            least.select("a", F.col("_least").alias("b"))
        )
    return linked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node.

    Alternates large and small stars until every component is one star; each round is
    written to the shared folder. Null ends and loops are ignored; repeated edges count once.
    """
    spark = edges.sparkSession
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, scratch_path(spark, "stars"))
    while not _only_stars(edges):
        edges = materialise(_star(_star(edges, True), False), scratch_path(spark, "stars"))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
