"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b, in either direction, repeats allowed. Result: node, root for every node of an edge but the roots;
    root is the smallest node that can be reached. Each round is written to the shared folder; the joins' large keys are split
    by adaptive execution, and the sums are taken before the shuffle."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = saved(edges, "edges")
    before, now = None, _state(edges)
    while before != now:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
