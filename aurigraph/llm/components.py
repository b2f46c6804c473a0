"""Connected components by alternating large and small stars, on joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the least of those."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("p"), F.col("a").alias("q")).filter("p <> q")
    return moved.unionByName(least.select(F.col("m").alias("p"), F.col("b").alias("q"))).select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars on their least nodes: no larger end has two edges or is the smaller end of another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("larger")), F.struct(F.col("b").alias("node"), F.lit(1).alias("larger")))).alias("end"))
    per = ends.groupBy("end.node").agg(F.sum("end.larger").alias("n"), F.min("end.larger").alias("least"))
    return per.filter("n > 1 OR n = 1 AND least = 0").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes that have an edge, stored; component is the least node. edges: (a, b), any orientation.

    No round follows once the edges are stars, and a round's tables go with it.
    """
    now = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        large = stored(_large_star(now), "components-large")
        discard(now)
        now = stored(_small_star(large), "components-edges")
        discard(large)
    else:
        raise RuntimeError(f"components had not settled after {most_rounds} rounds")
    found = stored(now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), "components")
    discard(now)
    return found
