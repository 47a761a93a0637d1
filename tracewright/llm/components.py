"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut


def _star(edges: DataFrame) -> DataFrame:
    """(centre, neighbour): for each u the least of u and its neighbours, given to the neighbours, and to u."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it reaches) for each node of edges(u, v); both of one orderable type.

    Each round halves the paths at least, is cut by a checkpoint, and ends when the edges are stars. A hub's edges are
    joined with its minimum, which Spark splits when they are many; the minimum itself is pre-aggregated.
    """
    flat = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to the least of u's neighbourhood.
        flat = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its neighbours below go to the least of them.
        starred = _star(flat)
        flat = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        flat = cut(flat)
        state = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = state
