"""Searches as one plan each: candidates, scores, role, fusion, duplicates, domain, page, snippets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import access, dense, fusion, index, lexical, rerank, results, store

POOL = 500


class Engine:
    """Searches over a document store and a vector table; queries are (query_id, query) with a vector column where dense ranks are asked for."""

    def __init__(self, docs: DataFrame, vectors: DataFrame, stored: Callable[[], index.Stored] | None = None, embed: Callable[[Column], Column] = dense.hash_embedding) -> None:
        """``stored`` gives an index that was built before (asked for at the first lexical search); without one texts are tokenised for each search."""
        self.docs, self.vectors, self.stored, self.embed = docs, vectors, stored, embed

    @cached_property
    def lexical(self) -> lexical.Lexical:
        return lexical.Lexical(self.stored() if self.stored else self.docs.filter(~F.col("is_deleted")))

    def _visible(self, role: str) -> DataFrame:
        return access.visible(self.docs, role).select("int_id")

    def lexical_ranks(self, queries: DataFrame, role: str, k: int = POOL) -> DataFrame:
        return lexical.top_k(self.lexical.scores(queries, self._visible(role)), k)

    def dense_ranks(self, queries: DataFrame, role: str, k: int = POOL) -> DataFrame:
        """Queries without a vector column are encoded; a blank query has no rows."""
        queries = queries.filter(F.coalesce(F.length(X.squeeze(F.col("query"))) > 0, F.lit(False)))
        if "vector" not in queries.columns:
            queries = queries.withColumn("vector", self.embed(F.col("query")))
        return dense.knn(self.vectors, queries, k, self._visible(role))

    def hybrid_ranks(self, queries: DataFrame, role: str, method: str = "weighted", alpha: float = 0.4, pool: int = POOL, k: int = POOL) -> DataFrame:
        return fusion.fuse(self.lexical_ranks(queries, role, pool), self.dense_ranks(queries, role, pool), method, alpha, k)

    def _shown(self, ranked: DataFrame, queries: DataFrame, top_k: int, offset: int, domain: str | None) -> DataFrame:
        rows = results.in_domain(results.distinct_content(results.hydrated(ranked, self.docs)), domain)
        return results.with_snippets(results.page(rows, top_k, offset), queries)

    def search_lexical(self, queries: DataFrame, role: str = "Public", top_k: int = 20, offset: int = 0, domain: str | None = None) -> DataFrame:
        _, top_k, offset, _ = results.checked("", top_k, offset)
        return self._shown(self.lexical_ranks(queries, role), queries, top_k, offset, domain).withColumn("lexical_score", F.col("score"))

    def search_dense(self, queries: DataFrame, role: str = "Public", top_k: int = 20, offset: int = 0, domain: str | None = None) -> DataFrame:
        _, top_k, offset, _ = results.checked("", top_k, offset)
        return self._shown(self.dense_ranks(queries, role), queries, top_k, offset, domain).withColumn("dense_score", F.col("score"))

    def search_hybrid(self, queries: DataFrame, role: str = "Public", top_k: int = 20, offset: int = 0, domain: str | None = None, method: str = "weighted", alpha: float = 0.4) -> DataFrame:
        _, top_k, offset, _ = results.checked("", top_k, offset)
        return self._shown(self.hybrid_ranks(queries, role, method, alpha), queries, top_k, offset, domain)

    def search_reranked(
        self, queries: DataFrame, role: str = "Public", top_k: int = 10, offset: int = 0, domain: str | None = None, pool: int = 50,
        use_reranker: bool = False, method: str = "weighted", alpha: float = 0.4, scorer: Callable[[Column, Column], Column] = rerank.overlap_score,
    ) -> DataFrame:
        """Hybrid candidates, the first ``PRUNE`` of which are scored anew; without a reranker they keep their order and have no rerank score."""
        _, top_k, offset, pool = results.checked("", top_k, offset, pool)
        ranked = self.hybrid_ranks(queries, role, method, alpha, POOL, pool + 100)
        rows = results.in_domain(results.distinct_content(results.hydrated(ranked, self.docs)), domain)
        rows = results.page(rows, min(pool, rerank.PRUNE), 0).drop("total_results", "page", "pages", "rank").withColumnRenamed("place", "rank")
        terms = queries.select("query_id", "query", F.array_distinct(X.tokenize(F.col("query"))).alias("terms"))
        rows = rows.join(terms, "query_id").withColumn("s", X.snippet(F.col("content"), F.col("terms")))
        text = rerank.candidate_text(F.col("title"), F.col("s.text"), F.col("content"))
        score = scorer(F.col("query"), text) if use_reranker else F.lit(None).cast("double")
        rows = rows.select("query_id", F.col("int_id").alias("doc_id"), "title", "url", "allowed_roles", "score", "lexical_score", "dense_score", "rank", F.col("s.text").alias("snippet"), score.alias("rerank_score"))
        if use_reranker:
            rows = rerank.reranked(rows)
        else:
            rows = rows.withColumn("place", F.col("rank"))
        return rows.filter((F.col("place") > offset) & (F.col("place") <= offset + top_k))

    def rag(self, queries: DataFrame, role: str = "Public", use_reranker: bool = True) -> DataFrame:
        """(query_id, prompt, overall_confidence, fallback_triggered)."""
        rows = self.search_reranked(queries, role, use_reranker=use_reranker)
        return rerank.prompts(rows, queries).join(rerank.fallback(rows, queries), "query_id")

    def answer(self, queries: DataFrame, role: str, model: Callable[[str], Iterator[str]] | None = None) -> Iterator[str]:
        """Frames for the first query: a model's answer, or the refusal where confidence is low."""
        row = self.rag(queries, role).first()
        return rerank.stream(row["prompt"] if row else "", model, refuse=row is None or row["fallback_triggered"])

    def ready(self) -> DataFrame:
        """One row (status, ready): whether the store can be read and the index has documents."""
        live = self.docs.filter(~F.col("is_deleted")).agg((F.count("*") > 0).alias("docs"))
        held = self.lexical.ids().agg((F.count("*") > 0).alias("index"))
        good = F.col("docs") & F.col("index")
        return live.crossJoin(held).select(F.when(good, "ready").otherwise("not ready").alias("status"), good.alias("ready"))

    def health(self, versions: DataFrame) -> DataFrame:
        live = self.docs.filter(~F.col("is_deleted")).select("int_id")
        return store.health(live, self.lexical.ids(), self.vectors.select("int_id"), versions)
