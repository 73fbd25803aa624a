"""Corpus pipeline: toxic documents go, one of each group of near copies stays, leaked benchmark items take their
documents out, sources are mixed to target weights, and what is left becomes token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
Every stage but the last returns the columns of ``documents``.

Defined cases, in all stages: columns beyond those of ``documents`` pass through whatever their names; rows of a null id are
kept by the filters and written first; an empty table goes through as one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, ngram_join, tokens, toxicity
from lodestone.llm.frames import cut, fresh

#: Near copies: five-word shingles, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80

ORACLE_SQL = None  # the first stage is a trained network, which SQL does not express


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold of their language.

    Null and empty texts are scored as texts without words, a null or unknown language has the common threshold, repeated
    rows are judged alike. Without labels of both classes every score is the share of toxic labels (0.5 without any).
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; texts without words all stay, rows of null id too.

    Rows that share an id are one document: they stay or go together.
    """
    mark = fresh(docs, "copy_id")
    joined = ngram_join.join(docs, WORDS, PERCENT).filter("component_id <> doc_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(cut(joined, "copies"), F.col("doc_id") == F.col(mark), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts and items match nothing, rows that share an id go together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that share an id are taken equally often.

    A null source is a source of its own; texts without words have no share of the target and come with the whole copies.
    """
    mark, times, nth = (fresh(docs, c) for c in ("mix_id", "mix_times", "mix_nth"))
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(mark)).agg(F.max("copies").cast("int").alias(times)).filter(F.col(times) > 0)
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(mark)))
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what the token files hold, a row for each row of docs.

    A null or empty text is the end id alone; a null id comes first, rows of one id follow each other by text.
    """
    return tokens.token_files(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
