"""Retrieval quality of ranked lists (query_id, int_id, rank) against relevant (query_id, int_id)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells of the histogram that finds a place.
CELLS = 4096


def _marked(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, hit, int_id, n_rel); a query without rows has one of nulls."""
    rel = relevant.select("query_id", "int_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    rows = ranked.join(rel.withColumn("hit", F.lit(1)), ["query_id", "int_id"], "left")
    return queries.select("query_id").distinct().join(rows, "query_id", "left").join(n, "query_id", "left").select("query_id", "int_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("n_rel", F.lit(0)).alias("n_rel"))


def ideal_gain(n: Column) -> Column:
    """Gain of n relevant rows at the head of a list."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(i <= n, 1.0 / F.log2(i + 1)).otherwise(0.0))


def by_query(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """All measures at k of each query.

    precision_core divides by k, precision_eval by what was retrieved; recall_core counts distinct rows, recall_eval places.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = _marked(ranked, relevant, queries)
    inside = F.col("rank") <= k
    hits = F.coalesce(F.sum(F.when(inside, F.col("hit"))), F.lit(0))
    found = F.countDistinct(F.when(inside & (F.col("hit") == 1), F.col("int_id")))
    shown = F.count_if(inside)
    n = F.max("n_rel")
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    gain = F.coalesce(F.sum(F.when(inside & (F.col("hit") == 1), 1.0 / F.log2(F.col("rank") + 1))), F.lit(0.0))
    sums = rows.groupBy("query_id").agg(hits.alias("hits"), found.alias("found"), shown.alias("shown"), n.alias("n"), first.alias("first"), gain.alias("gain"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return sums.select(
        "query_id", (F.col("hits") / F.lit(k)).alias("precision_core"), per("hits", "shown").alias("precision_eval"),
        per("found", "n").alias("recall_core"), per("hits", "n").alias("recall_eval"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr_full"), F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(F.lit(0.0)).alias("mrr_at_k"),
        F.when(F.col("n") > 0, F.col("gain") / ideal_gain(F.least(F.col("n"), F.lit(k)))).otherwise(F.lit(0.0)).alias("ndcg"),
    )


def report(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(metric, value): means over queries of the evaluation measures at each k."""
    out = None
    for k in ks:
        means = by_query(ranked, relevant, queries, k).agg(*(F.avg(c).alias(c) for c in ("precision_eval", "recall_eval", "mrr_at_k", "ndcg")))
        names = (("Precision", "precision_eval"), ("Recall", "recall_eval"), ("MRR", "mrr_at_k"), ("nDCG", "ndcg"))
        rows = means.select(F.explode(F.array(*(F.struct(F.lit(f"{n}@{k}").alias("metric"), F.col(c).alias("value")) for n, c in names))).alias("x")).select("x.*")
        out = rows if out is None else out.unionAll(rows)
    return out


def known_item(rows: DataFrame, wanted: Column, queries: DataFrame) -> DataFrame:
    """(query_id, rr) with one over the first place of a wanted row, 0 without one."""
    first = rows.filter(wanted).groupBy("query_id").agg((1.0 / F.min("rank")).alias("rr"))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce("rr", F.lit(0.0)).alias("rr"))


def ranked_values(df: DataFrame, value: str, places: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, names): the values at 0-based places (over n) of each group's values in ascending order; nulls take no part.

    A histogram finds the cell that a place falls in, and the counts of the values of that cell the value, so no group is
    put in order as a whole or gathered in one task.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    span = rows.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    same = lambda left, right: F.lit(True) if not keys else functools.reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))
    wide = F.col("high") - F.col("low")
    cell = F.when(wide > 0, F.least(F.floor((F.col("x") - F.col("low")) / wide * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0)).cast("long")
    a, b = rows.alias("a"), span.alias("b")
    placed = a.join(b, same(a, b)).select(*(F.col(f"a.{k}").alias(k) for k in keys), "x", "n", cell.alias("cell"))
    upto = F.sum("held").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("cell"))
    cells = placed.groupBy(*keys, "cell").agg(F.count("*").alias("held"), F.first("n").alias("n")).withColumn("upto", upto)
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items())))
    found = cells.withColumn("w", wanted).filter((F.col("w.place") < F.col("upto")) & (F.col("w.place") >= F.col("upto") - F.col("held")))
    found = found.select(*keys, "cell", F.col("w.name").alias("name"), (F.col("w.place") - F.col("upto") + F.col("held")).alias("left"))
    c, d = placed.groupBy(*keys, "cell", "x").agg(F.count("*").alias("held")).alias("c"), found.alias("d")
    inner = c.join(d, same(c, d) & (F.col("c.cell") == F.col("d.cell"))).select(*(F.col(f"c.{k}").alias(k) for k in keys), "name", "x", "held", "left")
    inner = inner.withColumn("upto", F.sum("held").over(Window.partitionBy(*keys, "name").orderBy("x")))
    at = inner.filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("held")))
    return at.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in places))


def latency(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, mean, median, p50_place, p95_place, p50_linear, p95_linear); percentiles are exact."""
    n = F.col("n")
    linear = {"p50": (n - 1) * 0.5, "p95": (n - 1) * 0.95}
    places = {"p50_place": F.floor(n / 2), "p95_place": F.floor(n * 0.95)} | {f"{k}_{side}": f(p) for k, p in linear.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    exact = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    both = exact.join(ranked_values(df, value, places, keys), keys)
    between = lambda k: F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (linear[k] - F.floor(linear[k]))
    both = both.withColumns({"p50_linear": between("p50"), "p95_linear": between("p95")})
    return both.select(*keys, "n", "mean", F.col("p50_linear").alias("median"), "p50_place", "p95_place", "p50_linear", "p95_linear")
