"""BM25 retrieval for batches of queries (query_id, query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import index as I

K1, B, PHRASE_BOOST = 1.5, 0.75, 5.0


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def weight(n: Column, df: Column, tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    score = idf(n, df) * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * length / avgdl))
    return F.when(avgdl > 0, score).otherwise(F.lit(0.0))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct tokens of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(X.tokenize(F.col("query")))).alias("term"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase_no, terms) of the quoted parts with more than one token, as often as they are quoted."""
    quoted = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit('"([^"]+)"'), F.lit(1))).alias("phrase_no", "words"))
    return quoted.select("query_id", "phrase_no", X.tokenize(F.col("words")).alias("terms")).filter(F.size("terms") > 1)


class Lexical:
    """Statistics are those of the whole index, whoever asks; what a role may see is cut out before scores are summed."""

    def __init__(self, docs: DataFrame | I.Stored) -> None:
        """Over documents, which are tokenised for every call, or over an index that is stored."""
        self.stored = docs if isinstance(docs, I.Stored) else None
        self.tokens = None if self.stored else I.tokens(docs)

    def held(self, terms: DataFrame) -> DataFrame:
        return self.stored.of(terms) if self.stored else I.postings(self.tokens, terms)

    def stats(self) -> DataFrame:
        return self.stored.stats if self.stored else I.corpus_stats(self.tokens)

    def ids(self) -> DataFrame:
        return (self.stored.docs if self.stored else self.tokens).select("int_id")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, int_id) of every document with a term of the query."""
        terms = query_terms(queries)
        return self.held(terms).join(terms, "term").select("query_id", "int_id").distinct()

    def scores(self, queries: DataFrame, visible: DataFrame | None = None, boost: float = PHRASE_BOOST) -> DataFrame:
        """(query_id, int_id, score); visible is (query_id, int_id) or (int_id)."""
        terms = query_terms(queries)
        held = self.held(terms)
        df = held.groupBy("term").agg(F.count("*").alias("df"))
        stats = self.stats()
        hits = held.join(df, "term").join(terms, "term").crossJoin(F.broadcast(stats))
        if visible is not None:
            hits = hits.join(visible, visible.columns, "left_semi")
        part = weight(F.col("n_docs"), F.col("df"), F.col("tf"), F.col("doc_len"), F.col("avgdl"))
        base = hits.groupBy("query_id", "int_id").agg(F.sum(part).alias("score"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("where"))
        known = query_phrases(queries).select("query_id", "phrase_no", F.posexplode("terms").alias("i", "term")).join(df.select("term"), "term", "left_semi")
        phrases = known.groupBy("query_id", "phrase_no").agg(F.sort_array(F.collect_list(F.struct("i", "term"))).alias("t")).select("query_id", F.col("t.term").alias("terms")).filter(F.size("terms") > 1)
        by_query = phrases.groupBy("query_id").agg(F.collect_list("terms").alias("phrases"))
        chain = lambda t: F.aggregate(
            F.slice(t, F.lit(2), F.size(t)), F.try_element_at("where", F.get(t, 0)), lambda acc, nxt: F.array_intersect(F.transform(acc, lambda p: p + 1), F.try_element_at("where", nxt))
        )
        gain = F.aggregate(F.coalesce("phrases", F.array().cast("array<array<string>>")), F.lit(0.0), lambda acc, t: acc + F.when(F.size(chain(t)) > 0, boost * F.size(t)).otherwise(0.0))
        return base.join(by_query, "query_id", "left").select("query_id", "int_id", (F.col("score") + gain).alias("score"))


def top_k(scores: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranked rows of each query: highest score first, ties by smaller int_id. Scores tie at ten places, so the order of a sum does not tell."""
    if k <= 0:
        return scores.withColumn("rank", F.lit(0)).limit(0)
    order = Window.partitionBy(*keys).orderBy(F.round("score", 10).desc(), F.col("int_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

