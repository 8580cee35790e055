"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherry.llm.common import by_size, materialize


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges``: a, b. The root is the smallest node reachable.

    Each round is a fixed number of joins and aggregations on keys; nothing is collected but a checksum.
    Every round's edges are written to the shared folder, so lost executors cost one round at most.
    Rounds grow with the logarithm of the largest component; not to end within ``max_rounds`` is an error. An empty table gives an empty table.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e)
    before = None
    for k in range(max_rounds + 1):
        mark = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before or not mark[0]:
            break
        if k == max_rounds:
            raise RuntimeError(f"components are not finished after {max_rounds} rounds")
        before = mark
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # Large star: every larger neighbour hangs on the least neighbour.
        large = both.filter("b > a").join(by_size(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = materialize(large)
        # Small star: a node's smaller neighbours and itself hang on the least of them.
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(by_size(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        e = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct())
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
