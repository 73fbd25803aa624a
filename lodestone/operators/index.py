"""Positional inverted index as tables: tokens, postings, statistics, and their maintenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources.corpus import listed
from lodestone.storage import work_path

#: Folders that postings are dealt to by term, and query terms up to which these are named in the scan.
PARTS, NAMED = 64, 1000
_POSTINGS = "int_id long, term string, tf long, positions array<int>, doc_len long, part int"
_INSIDE = "array<struct<term: string, positions: array<int>>>"


def tokens(docs: DataFrame, id_col: str = "int_id", text_col: str = "content") -> DataFrame:
    """(int_id, tokens): the forward index."""
    return docs.select(F.col(id_col).alias("int_id"), F.coalesce(X.tokenize(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))


def _inside(tokens: Column) -> Column:
    """Array of (term, positions) of one document, by term: its tokens are sorted with their places and cut where the term changes."""

    def cut_at(s: Column, starts: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(s))
        held = lambda i, k: F.transform(F.slice(s, i + 1, stop(k) - i), lambda x: x["pos"])
        return F.transform(starts, lambda i, k: F.struct(F.get(s, i)["term"].alias("term"), held(i, k).alias("positions")))

    placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    changed = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i)), lambda i: i.isNotNull())
    return X.let(placed, lambda s: X.let(changed(s), lambda starts: cut_at(s, starts)))


def _grouped(toks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    rows = toks.select("int_id", F.size("tokens").cast("long").alias("doc_len"), F.posexplode("tokens").alias("pos", "term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("int_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("doc_len").alias("doc_len"))


def postings(toks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(int_id, term, tf, positions, doc_len); with terms only theirs, so that other tokens are never shuffled.

    Without terms the postings of a row are made within the row, and only ids that several rows have are put together by a shuffle.
    """
    return _grouped(toks, terms) if terms is not None else _whole(toks, F.array().cast(_INSIDE))


def _whole(toks: DataFrame, more: Column) -> DataFrame:
    """All postings, and ``more`` (term, positions) of each row."""
    own = lambda df, held: df.select("int_id", F.size("tokens").cast("long").alias("doc_len"), F.explode(held).alias("p")).select(
        "int_id", "p.term", F.size("p.positions").cast("long").alias("tf"), "p.positions", "doc_len"
    )
    all_of = F.concat(more, _inside(F.col("tokens")))
    several = toks.groupBy("int_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("int_id").alias("several"))
    if several.isEmpty():
        return own(toks, all_of)
    several = listed(several)
    same = F.col("int_id").eqNullSafe(F.col("several"))
    met = toks.join(several, same, "left_semi")
    return own(toks.join(several, same, "left_anti"), all_of).unionByName(_grouped(met)).unionByName(own(met, more))


def doc_stats(toks: DataFrame) -> DataFrame:
    return toks.select("int_id", F.size("tokens").cast("long").alias("doc_len"))


def corpus_stats(toks: DataFrame) -> DataFrame:
    """One row: (n_docs, total_tokens, avgdl); documents without tokens count too."""
    total = F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long")
    n = F.count("*")
    return toks.agg(n.alias("n_docs"), total.alias("total_tokens"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avgdl"))


def term_stats(toks: DataFrame) -> DataFrame:
    """(term, df, cf) by partial counts; no list of documents is built."""
    inside = toks.select(F.explode("tokens").alias("term"), "int_id").groupBy("term", "int_id").agg(F.count("*").alias("tf"))
    return inside.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def replaced(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings after documents were added or replaced."""
    return without(index, fresh.select("int_id")).unionByName(fresh)


def without(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings (or vectors) after documents went; ids that are not there change nothing."""
    return index.join(ids.select("int_id").distinct(), "int_id", "left_anti")


def write_generation(index: DataFrame, folder: str, version: int, partitions: int = 64) -> str:
    """Write postings of a generation, dealt and sorted by term, so that a term's rows lie together; returns its path."""
    path = f"{folder}/generation={version}"
    index.repartition(partitions, "term").sortWithinPartitions("term", "int_id").write.mode("overwrite").parquet(path)
    return path


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


@dataclass
class Stored:
    """An index that was built once: postings dealt to folders by term and sorted by it, and the statistics of all documents."""

    spark: SparkSession
    folder: str

    @property
    def docs(self) -> DataFrame:
        """(int_id, doc_len)."""
        return self.spark.read.parquet(f"{self.folder}/docs")

    @property
    def stats(self) -> DataFrame:
        """One row, as of ``corpus_stats``."""
        return self.spark.read.parquet(f"{self.folder}/stats")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/postings").filter("term is not null").drop("part")

    def of(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms (term): the scan reads the folders of these terms only."""
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/postings")
        wanted = terms.select("term", _part(F.col("term")).alias("part")).distinct()
        named = wanted.limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            rows = rows.filter(F.col("part").isin([r["part"] for r in named]) & F.col("term").isin([r["term"] for r in named]))
        else:
            rows = rows.join(wanted, ["part", "term"], "left_semi")
        return rows.drop("part")


def build(docs: DataFrame, folder: str | None = None) -> Stored:
    """Build and write the index of documents (int_id, content): texts are tokenised once and postings shuffled once, to their folders."""
    spark = docs.sparkSession
    folder = folder or work_path(spark, "index")
    # a row without a term stands for the document itself
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.array().cast("array<int>").alias("positions")))
    rows = _whole(tokens(docs), itself).drop("tf").withColumn("part", F.when(F.col("term").isNull(), -1).otherwise(_part(F.col("term"))))
    # a folder whose terms are frequent is written by several tasks
    dealt = rows.hint("rebalance", "part").select("int_id", "term", F.size("positions").cast("long").alias("tf"), "positions", "doc_len", "part")
    dealt.sortWithinPartitions("part", "term", "int_id").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    written = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings").filter("part = -1")
    written.groupBy("int_id").agg(F.first("doc_len").alias("doc_len")).write.mode("overwrite").parquet(f"{folder}/docs")
    total, n = F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long"), F.count("*")
    made = Stored(spark, folder)
    made.docs.agg(n.alias("n_docs"), total.alias("total_tokens"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    return made
