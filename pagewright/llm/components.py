"""Connected components of a graph given as edges, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialise


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of ``edges`` (columns a and b, long).

    Alternates large and small stars: each node's larger neighbours, and then its smaller ones, are tied to the
    smallest it knows, until all edges are stars. Rounds grow as the logarithm of the longest path. What a round
    makes is written to the shared folder, so nothing depends on an executor that has gone. The smallest neighbours
    are a written table as well: then both sides of each join come from a shuffle of their own, and the one key of a
    large star is split over tasks. Loops keep lone nodes. ``edges`` must still be readable when the result is read.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _is_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        low = materialise(low, "low")
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "low")
        small = large.join(least, F.col("u") == F.col("n"))
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = materialise(moved.where("u <> v").distinct(), "edges")
        discard(now, low, large, least)
        now = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    centres = now.select(F.col("u").alias("n"), F.col("v").alias("m"))
    return nodes.join(centres, F.col("node") == F.col("n"), "left").select("node", F.coalesce("m", "node").alias("component"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node is tied to one node, which is tied to none."""
    several = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("u")
    chained = edges.join(edges.select(F.col("v").alias("n")).distinct(), F.col("u") == F.col("n"), "left_semi").select("u")
    return not several.limit(1).unionByName(chained.limit(1)).count()
