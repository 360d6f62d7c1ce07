"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Each round hangs the larger neighbours of a node, then the smaller ones, on its smallest neighbour,
    so the number of rounds grows with the logarithm of the longest path. Edges never grow in number and
    are written to the shared folder each round. A hub's rows take part in joins only, which Spark splits.
    Rows with a null end and self-links are ignored; no edges give no rows.
    """
    ends = F.col("a") != F.col("b")
    edges = stage(edges.where(ends).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(ends).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stage(small.distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
    raise RuntimeError(f"components have not settled in {limit} rounds")
