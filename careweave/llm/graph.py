"""Connected components of large edge lists by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careweave.llm import common


def _checksum(edges: DataFrame) -> tuple:
    # two numbers, whatever the size
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node of ``edges`` (u, v); the root is the least node of its
    component. Nodes without an edge to another one may be missing from the result.

    Each round replaces stars by minima with pre-aggregated counts and equi-joins, never
    gathering the neighbours of a node, and is written to the shared folder. The rounds
    grow with the logarithm of the longest path, not with the size of a component."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.written(edges, "edges")
    before = _checksum(edges)
    while before[0]:
        last = edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = common.written(edges, "edges", instead_of=last)
        after = _checksum(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(roots).select(F.col("u").alias("v"), F.col("v").alias("root"))
