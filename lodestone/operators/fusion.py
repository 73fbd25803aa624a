"""Fusion of ranked lists (query_id, int_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lexical import top_k

RRF_K = 60


def minmax(ranked: DataFrame) -> DataFrame:
    """Scores of each query from 0 to 1; 1 where all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("score", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def _sides(ranked: DataFrame, name: str, share: Column) -> DataFrame:
    """(query_id, int_id, s, lexical_score, dense_score): a side's share of the fused score, and its own score under its name."""
    sides = [(F.col("own") if side == name else F.lit(None)).cast("double").alias(side) for side in ("lexical_score", "dense_score")]
    return ranked.select("query_id", "int_id", share.alias("s"), *sides)


def _summed(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Ranks by the sum of both shares; each side's score comes along, so that no side is computed again."""
    sums = a.unionAll(b).groupBy("query_id", "int_id").agg(F.sum("s").alias("score"), F.max("lexical_score").alias("lexical_score"), F.max("dense_score").alias("dense_score"))
    return top_k(sums, k)


def weighted(lexical: DataFrame, dense: DataFrame, alpha: float, k: int) -> DataFrame:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must lie in [0, 1]")
    part = lambda df, name, w: _sides(minmax(df.withColumn("own", F.col("score"))), name, F.lit(w) * F.col("score"))
    return _summed(part(lexical, "lexical_score", float(alpha)), part(dense, "dense_score", 1.0 - alpha), k)


def rrf(lexical: DataFrame, dense: DataFrame, alpha: float, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal ranks, summed with weights alpha and 1 - alpha."""
    if rrf_k <= 0:
        raise ValueError("k must be positive")
    part = lambda df, name, w: _sides(df.withColumn("own", F.col("score")), name, F.lit(w) / (rrf_k + F.col("rank")))
    return _summed(part(lexical, "lexical_score", float(alpha)), part(dense, "dense_score", 1.0 - alpha), k)


def rrf_grid(lexical: DataFrame, dense: DataFrame, alphas: list[float], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion (alpha, query_id, int_id, score, rank) for many weights at once, from one pass over both lists."""
    grid = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    part = lambda df, w: df.select("query_id", "int_id", "rank", grid).select("alpha", "query_id", "int_id", (w / (rrf_k + F.col("rank"))).alias("s"))
    both = part(lexical, F.col("alpha")).unionAll(part(dense, 1.0 - F.col("alpha")))
    return top_k(both.groupBy("alpha", "query_id", "int_id").agg(F.sum("s").alias("score")), k, ("alpha", "query_id"))


def fuse(lexical: DataFrame, dense: DataFrame, method: str, alpha: float, k: int) -> DataFrame:
    """Fused ranks with the scores of both sides (null where a side lacks the row)."""
    if method not in ("weighted", "rrf"):
        raise ValueError(f"unknown fusion {method}")
    return (weighted if method == "weighted" else rrf)(lexical, dense, alpha, k)
