"""What happens to ranked rows before they are shown: hydration, duplicates, domain, pages, snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U

MAX_TOP_K, MAX_OFFSET, MAX_QUERY, MAX_POOL = 100, 10_000, 500, 500


def checked(query: str, top_k: int, offset: int, pool: int = MAX_POOL) -> tuple[str, int, int, int]:
    """Parameters as they hold; ValueError for those that cannot be mended."""
    query = " ".join((query or "").split())
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if len(query) > MAX_QUERY:
        raise ValueError("the query is too long")
    if pool < 1:
        raise ValueError("the pool must hold at least one candidate")
    return query, min(top_k, MAX_TOP_K), min(offset, MAX_OFFSET), min(pool, MAX_POOL)


def hydrated(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked rows with the columns of their live documents; rows without one vanish."""
    shown = docs.filter(~F.col("is_deleted")).select(
        "int_id", "content_hash", "allowed_roles",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Document")).alias("title"),
        F.coalesce(F.nullif("url", F.lit("")), F.lit("unknown-url")).alias("url"),
        F.coalesce("content", F.lit("")).alias("content"),
    )
    return ranked.join(shown, "int_id")


def distinct_content(rows: DataFrame) -> DataFrame:
    """The first row by rank of each content, in each query."""
    w = Window.partitionBy("query_id", "content_hash").orderBy("rank")
    return rows.withColumn("copy", F.row_number().over(w)).filter("copy = 1").drop("copy")


def in_domain(rows: DataFrame, domain: str | None) -> DataFrame:
    """After duplicates went, so a copy outside the domain can hide one inside."""
    return rows.filter(U.in_domain(F.col("url"), domain)) if domain else rows


def page(rows: DataFrame, top_k: int, offset: int) -> DataFrame:
    """Rows offset + 1 to offset + top_k of each query, their place, and the number of all rows."""
    w = Window.partitionBy("query_id")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy("rank"))).withColumn("total_results", F.count("*").over(w))
    shown = placed.filter((F.col("place") > offset) & (F.col("place") <= offset + top_k))
    return shown.withColumn("page", F.floor(F.lit(offset) / F.lit(top_k)) + 1).withColumn("pages", F.ceil(F.col("total_results") / F.lit(top_k)))


def with_snippets(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows with snippet and matches in place of the content."""
    terms = queries.select("query_id", F.array_distinct(X.tokenize(F.col("query"))).alias("terms"))
    cut = rows.join(terms, "query_id").withColumn("s", X.snippet(F.col("content"), F.col("terms")))
    return cut.withColumns({"snippet": F.col("s.text"), "matches": F.col("s.matches")}).drop("s", "terms", "content")


