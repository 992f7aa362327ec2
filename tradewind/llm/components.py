"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    kept = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", "m")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node that can be reached.

    Loops and repeated edges do no harm, edges with a null end are left out, an empty table gives an empty result.
    Each round is written to the shared folder; the driver sees only a count and a checksum of it. The rounds
    needed grow with the logarithm of the longest chain.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = staged(edges, "edges")
    state = _state(edges)
    while state[0]:
        before, edges = edges, staged(_small_star(_large_star(edges)), "edges")
        last, state = state, _state(edges)
        discard(before)
        if last == state:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(edges.select("b", "b").distinct())
