"""Connected components of an edge table, on Spark.

Large-star and small-star steps alternate: each links a node's neighbours to the
smallest of them, until every edge leads from a node to its component's smallest
node. Minima are combined before they are shuffled, stored, and joined back to
the edges, so a node with very many neighbours is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tasks import stored


def _links(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return _links(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return _links(edges.join(least, "u").select(F.explode(F.array(
        F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*"))


def _sum(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node with an edge to another, ``component`` the smallest node it reaches.

    Edges with a null end, loops and repeated edges count for nothing. Work
    ends when a round changes no edge; rounds grow with the logarithm of the
    longest path.
    """
    now = stored(_links(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()), "edges")
    before, found = None, _sum(now)
    while found[0] and found != before:
        now = stored(_small_star(_large_star(now)), "edges")
        before, found = found, _sum(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
