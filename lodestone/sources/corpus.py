"""Sources: the document store over the driver's tables, generated corpora, evaluation sets, HTML files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions import text as X
from lodestone.functions import urls as U

SEGMENTS = ("eng", "hr", "finance", "internal", "docs")
ROLES = ("Admin", "HR", "Engineering", "Public", "Finance")
STATUSES = ("PENDING", "INDEXED", "FAILED")
#: Columns that older stores lack, and what they hold then.
ADDED = {"version": "1", "is_deleted": "false", "indexing_status": "'PENDING'", "updated_at": "cast(null as timestamp)", "allowed_roles": "'Public'"}


#: Rows up to which a list goes to every worker.
LISTED = 10_000


def listed(df: DataFrame) -> DataFrame:
    """A list to join with, all of it: broadcast up to LISTED rows, else as Spark deals it."""
    return F.broadcast(df) if df.limit(LISTED + 1).count() <= LISTED else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of the document store."""
    d = F.col("doc_id")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), _pick(d % 5, SEGMENTS), F.lit("/"), d.cast("string"))
    status = F.when(d % 10 == 0, "PENDING").when(d % 10 == 1, "FAILED").otherwise("INDEXED")
    return table(spark, sf_dir, "documents").select(
        d.alias("int_id"), X.sha_id(url).alias("id"), url.alias("url"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("content"), X.sha_id(F.col("text")).alias("content_hash"), U.assigned_role(url).alias("allowed_roles"),
        (1 + (d % 3 == 0).cast("int")).alias("version"), (d % 97 == 0).alias("is_deleted"), status.alias("indexing_status"),
    )


def live(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("is_deleted"))


def pending(docs: DataFrame) -> DataFrame:
    """Rows that the next index run takes up, live ones and tombstones."""
    return docs.filter(F.col("indexing_status") == "PENDING")


def migrated(docs: DataFrame) -> DataFrame:
    """Older rows with the added columns at their defaults; running it twice changes nothing."""
    for name, value in ADDED.items():
        docs = docs.withColumn(name, F.coalesce(F.col(name), F.expr(value)) if name in docs.columns else F.expr(value))
    return docs


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("int_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """The scale-test corpus: n templated documents whose roles take turns."""
    i = F.col("id")
    role = _pick(i % 5, ROLES)
    return spark.range(n).select(
        i.alias("int_id"), F.concat(F.lit("doc_"), i).alias("id"), F.concat(F.lit("http://internal/"), i).alias("url"), F.concat(F.lit("Scale Document "), i).alias("title"),
        F.concat(F.lit("This is a massive scale test document. Index "), i, F.lit(". Relevant to "), role, F.lit(".")).alias("content"),
        F.concat(F.lit("hash_"), i).alias("content_hash"), role.alias("allowed_roles"), F.lit("PENDING").alias("indexing_status"),
    )


#: The topics of the row-security corpus.
TOPICS = ("bonus", "architecture", "holiday", "layoff", "revenue", "roadmap", "cafeteria")


def role_corpus(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """The row-security test corpus: n documents whose roles and topics are drawn by a seeded hash, so that runs agree."""
    i = F.col("id")
    draw = lambda salt, values: _pick(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values))), values)
    rows = spark.range(n).select(i, draw(1, ROLES).alias("role"), draw(2, TOPICS).alias("topic"))
    return rows.select(
        i.alias("int_id"), F.concat(F.lit("doc_"), i).alias("id"), F.concat(F.lit("http://internal/"), i).alias("url"), F.concat(F.lit("Topic: "), F.col("topic")).alias("title"),
        F.concat(F.lit("Detailed confidential document about "), F.col("topic"), F.lit(" for "), F.col("role"), F.lit(" only.")).alias("content"),
        F.concat(F.lit("hash_"), i).alias("content_hash"), F.col("role").alias("allowed_roles"), F.lit("PENDING").alias("indexing_status"),
    )


def judged_corpus(spark: SparkSession, corpus_path: str, queries_path: str, qrels_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, title, text, content), (query_id, query) and (query_id, doc_id, score) of a judged corpus in the usual three files.

    Corpus and queries are JSON lines with _id, title and text, judgements tab-separated with a header query-id, corpus-id,
    score. Judgements of documents that the corpus lacks or of no relevance are left out, and queries without any left.
    """
    docs = spark.read.schema("_id string, title string, text string").json(corpus_path)
    docs = docs.select(F.col("_id").alias("doc_id"), "title", "text", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("content"))
    marks = spark.read.option("header", True).option("sep", "\t").schema("`query-id` string, `corpus-id` string, score int").csv(qrels_path)
    rel = marks.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), "score").filter("score > 0").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", "doc_id", "score")
    asked = spark.read.schema("_id string, text string").json(queries_path).select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    return docs, asked.join(rel.select("query_id").distinct(), "query_id", "left_semi"), rel


def random_unit_vectors(spark: SparkSession, n: int, dim: int = 384, seed: int = 42) -> DataFrame:
    raw = spark.range(n).select(F.col("id").alias("int_id"), F.array(*(F.rand(seed + k) for k in range(dim))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return raw.select("int_id", F.transform("v", lambda x: x / norm).alias("embedding"))


def eval_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, query) and (query_id, doc_id) of a JSON list of {query, relevant_docs}."""
    rows = spark.read.schema("query string, relevant_docs array<string>").json(path, multiLine=True)
    rows = rows.withColumn("query_id", F.xxhash64("query"))
    return rows.select("query_id", "query"), rows.select("query_id", F.explode("relevant_docs").alias("doc_id"))


def html_files(spark: SparkSession, path: str, base: str) -> DataFrame:
    """(url, html) of the .html files below path; the url is the place below base."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(path)
    place = F.regexp_replace(F.col("path"), r"^[a-z]+:/*(?=/)", "")
    return raw.select(F.substring(place, F.lit(len(base.rstrip("/")) + 2), F.length(place)).alias("url"), F.decode("content", "UTF-8").alias("html"))


#: Words of a passage by whose hash documents are met, and keywords that one pass over the titles looks for.
ANCHOR, BLOCK = 4, 50_000


def _runs(words: Column) -> Column:
    """Array of hashes of the runs of ANCHOR words that begin at each word; those that the end cuts off are null."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.zip_with(pairs, F.slice(pairs, F.lit(3), F.size(pairs)), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, int_id) of the documents (int_id, content) that hold a passage (query_id, passage) as it is.

    The words inside a passage stand whole in a document that holds it, so both meet by the hash of a run of them (the
    longest in letters) and only such pairs are compared; passages of too few words are compared with every document.
    """
    split = lambda c: F.split(c, r"\s+")
    known = passages.filter("passage is not null").withColumn("words", split(F.col("passage")))
    inner = F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0)))
    known = known.select("query_id", "passage", inner.alias("inner"))
    long = F.transform(F.sequence(F.lit(1), F.size("inner") - ANCHOR + 1), lambda i: F.struct(F.length(F.array_join(F.slice("inner", i, ANCHOR), " ")).alias("n"), F.get(_runs(F.col("inner")), i - 1).alias("key")))
    keyed = known.filter(F.size("inner") >= ANCHOR).select("query_id", F.array_max(long)["key"].alias("k"))
    runs = docs.filter("content is not null").select("int_id", F.explode(_runs(split(F.col("content")))).alias("key"))
    met = runs.join(listed(keyed), F.col("key") == F.col("k")).select("query_id", "int_id").distinct()
    texts = met.join(docs.select("int_id", "content"), "int_id").join(listed(known.select("query_id", "passage")), "query_id")
    short = docs.select("int_id", "content").join(listed(known.filter(F.size("inner") < ANCHOR).select("query_id", "passage")), F.contains("content", "passage"))
    return texts.filter(F.contains("content", "passage")).select("query_id", "int_id").unionAll(short.select("query_id", "int_id"))


def _matcher(words: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for w in words:
            tree.add_word(w, w)
        tree.make_automaton()
        for f in frames:
            rows = [(i, w) for i, t in zip(f["id"], f["t"], strict=True) for w in {w for _, w in tree.iter(t)}]
            yield pd.DataFrame(rows, columns=["id", "kw"], dtype=object)

    return over


def weak_qrels(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id): documents whose title holds one of the query's keywords; queries are (query, keywords) rows.

    All keywords are looked for in one pass over a title, BLOCK of them a pass over the table; an empty one is in every title.
    """
    asked = queries.select("query", F.explode("keywords").alias("kw")).filter("kw is not null").distinct()
    titles = docs.select("id", F.lower(F.coalesce("title", F.lit(""))).alias("t"))
    every = asked.filter("kw = ''").select("query").distinct().crossJoin(titles.select("id")) if not asked.filter("kw = ''").isEmpty() else None
    words = asked.filter("kw <> ''").select("kw").distinct().withColumn("block", F.pmod(F.xxhash64("kw"), F.lit(max(1, -(-asked.count() // BLOCK)))))
    found = every
    for (block,) in words.select("block").distinct().collect():
        held = [r[0] for r in words.filter(F.col("block") == block).select("kw").collect()]
        hit = titles.mapInPandas(_matcher(held), StructType([titles.schema["id"], StructField("kw", StringType())])).join(listed(asked), "kw").select("query", "id")
        found = hit if found is None else found.unionAll(hit)
    return found.distinct() if found is not None else asked.select("query").join(titles.select("id").limit(0), F.lit(False))
