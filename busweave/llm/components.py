"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from busweave.session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of u to the least of u and its neighbours.

    ``large``: only neighbours above u, seen from both ends; otherwise each edge
    belongs to its larger end.  Minima are partial aggregates.  They are written
    before the join back: Spark then broadcasts them if they are small, or else
    joins two plain shuffles, which it can split, so that a hub of any degree is
    spread over tasks.
    """
    if large:
        sided = edges.union(edges.select("v", "u"))
    else:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sided.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("hub"), F.least("u", "m").alias("m")
    )
    least = settle(least, "hubs")
    joined = sided.join(least, F.col("u") == F.col("hub"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("hub").alias("u"), F.col("m").alias("v"))
        )
    return out.filter("u <> v") if large else out.filter("u <> v").distinct()


def _is_settled(edges: DataFrame) -> bool:
    """True if every node has one parent and no parent has one itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter((F.col("up") > 1) | (F.col("up") + F.col("down") > 1)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable, for nodes with an edge.

    ``edges`` has long columns u and v.  Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    """
    sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = settle(sided.filter("u <> v").distinct(), "edges")
    while not _is_settled(edges):
        edges = settle(_star(_star(edges, large=True), large=False), "edges")
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
