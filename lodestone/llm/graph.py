"""Connected components by alternating large-star and small-star steps; every step is a join and a partial minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.frames import cut

MAX_STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to another; edges are (a, b) of longs, components smallest nodes.

    Edges of a node to itself count nothing, repeated edges once. An empty table of edges gives an empty result.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_STEPS):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).withColumn("m", F.least("k", "m"))
        large = both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.filter("a <> b"), "edges")
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        now = cut(small.filter("a <> b").distinct(), "edges")
    raise RuntimeError("components did not settle")
