"""Reranking, the confidence gate and prompt assembly; scorers and language models are plugged in as functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: Rows that are scored anew, the logit that a row without a score counts, the confidences of the gate.
PRUNE = 15
NO_LOGIT = -99.0
CORRECT, AMBIGUOUS = 0.75, 0.30
#: The texts that a language model and a reader get.
SYSTEM = (
    "You are a highly accurate internal search assistant. Answer strictly using the provided documents. If the documents do not contain the answer, "
    "say 'I cannot answer this query based on the available documents.' Always cite your sources using [1], [2], etc."
)
REFUSAL = "I cannot answer this query based on the verified documents available to your clearance level."


def candidate_text(title: Column, snippet: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), F.coalesce(content, F.lit("")))


def overlap_score(query: Column, text: Column) -> Column:
    """A fixed stand-in for a cross-encoder: share of the query's terms among the text's tokens, as a log odds."""
    terms = F.array_distinct(X.tokenize(query))
    tokens = X.tokenize(X.truncated(text))
    share = F.size(F.array_intersect(terms, tokens)) / F.greatest(F.size(terms), F.lit(1))
    return X.logit(share)


def cross_encoder(load: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer of a model that takes lists of up to ``batch`` pairs (query, text) and gives probabilities; ``load`` runs once in a task."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in parts:
            pairs = list(zip(queries.fillna(""), texts.fillna(""), strict=True))
            out: list[float] = []
            for at in range(0, len(pairs), batch):
                out += [float(p) for p in model(pairs[at : at + batch])]
            yield pd.Series(out, dtype="float64")

    return lambda query, text: X.logit(run(query, X.truncated(text)))


def reranked(rows: DataFrame, top_k: int = 0) -> DataFrame:
    """Rows (query_id, doc_id, rerank_score) in new places: highest score first, without score last, ties by doc_id as text; top_k 0 keeps all."""
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("doc_id").cast("string"))
    placed = rows.withColumn("place", F.row_number().over(w))
    return placed.filter(F.col("place") <= top_k) if top_k > 0 else placed


def confidence(logit: Column) -> Column:
    """Struct of score and status of a logit."""
    p = X.sigmoid(logit)
    return F.struct(p.alias("score"), F.when(p >= CORRECT, "CORRECT").when(p >= AMBIGUOUS, "AMBIGUOUS").otherwise("INCORRECT").alias("status"))


def fallback(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, overall_confidence, fallback_triggered) by the first place of each query; a missing logit counts -99, no rows as no confidence."""
    best = rows.groupBy("query_id").agg(F.min_by(F.coalesce("rerank_score", F.lit(NO_LOGIT)), "place").alias("logit"))
    sure = F.coalesce(confidence(F.col("logit"))["score"], F.lit(0.0))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", sure.alias("overall_confidence"), (sure < AMBIGUOUS).alias("fallback_triggered"))


def prompts(rows: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, prompt) from the first rows (query_id, place, title, snippet)."""
    line = F.concat(F.lit("Document ["), F.col("place").cast("string"), F.lit("] ("), F.col("title"), F.lit("): "), F.col("snippet"))
    first = rows.filter(F.col("place") <= top).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    context = F.array_join(F.transform("lines", lambda s: s["line"]), "\n\n")
    text = F.concat(F.lit(f"<|system|>\n{SYSTEM}</s>\n<|user|>\nContext:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuery: "), F.col("query"), F.lit("</s>\n<|assistant|>\n"))
    return queries.join(first, "query_id", "left").select("query_id", text.alias("prompt"))


def framed(message: Column) -> Column:
    """Array of the stream's frames: each word, then the end."""
    words = F.filter(F.split(message, r"\s+"), lambda w: w != "")
    token = lambda w: F.regexp_replace(F.to_json(F.struct(F.concat(w, F.lit(" ")).alias("token"))), r'^\{"token":', '{"token": ')
    frames = F.transform(words, lambda w: F.concat(F.lit("data: "), token(w), F.lit("\n\n")))
    return F.concat(frames, F.array(F.lit("data: [DONE]\n\n")))


def stream(prompt: str, model: Callable[[str], Iterator[str]] | None, refuse: bool = False) -> Iterator[str]:
    """Frames of a model's answer; of the refusal where it is asked for, of the error where the model fails."""
    frame = lambda token: f"data: {json.dumps({'token': token})}\n\n"
    if refuse or model is None:
        yield from (frame(w + " ") for w in REFUSAL.split())
    else:
        try:
            yield from (frame(t) for t in model(prompt) if t != "</s>")
        except Exception as error:  # the reader of the stream is told, whatever went wrong
            yield from (frame(w + " ") for w in f"[API Error: {error}]".split())
    yield "data: [DONE]\n\n"


def impact(before: DataFrame, after: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (improved, degraded, same) by the first relevant place before and after; rows are (query_id, int_id, place)."""
    first = lambda df, name: df.join(relevant, ["query_id", "int_id"], "left_semi").groupBy("query_id").agg(F.min("place").cast("double").alias(name))
    none = F.lit(float("inf"))
    rows = queries.select("query_id").join(first(before, "b"), "query_id", "left").join(first(after, "a"), "query_id", "left")
    b, a = F.coalesce("b", none), F.coalesce("a", none)
    return rows.agg(F.count_if(a < b).alias("improved"), F.count_if(a > b).alias("degraded"), F.count_if(a == b).alias("same"))
