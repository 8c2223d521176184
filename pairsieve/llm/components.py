"""Connected components of an undirected graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsieve.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: ``root`` is the smallest node that can be reached.

    Large-star and small-star steps in turn: each links a node's neighbours to the smallest of them, until every edge leads
    from a node to its root. The number of rounds grows with the logarithm of the longest path. Each round is a
    grouped minimum with partial sums per task and a join on the node, written to the shared folder; only the number of
    edges and a checksum of them reach the driver, to see whether a round has changed anything.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "edges")
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(lowest, "a")
        small = joined.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = materialise(small.where("a <> b").distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("bit_xor(xxhash64(b, a, 7))").alias("y")
    ).first()
    return (row.n, row.x, row.y) if row.n else (0, 0, 0)
