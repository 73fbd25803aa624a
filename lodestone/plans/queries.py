"""Registered queries of the engine; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.operators import access, dense, fusion, index, lexical, metrics, rerank, results, store
from lodestone.plans.search import Engine
from lodestone.sources import corpus, crawl, html

TEXTS = ["heat ver", "ndnd heha", "pfach stung", '"of the" thin', '"et de" la', 'der "in der" zzzunknown']
PAGE_ROLE = "Engineering"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): query n also has the vector of vec_id 10 n, see asked_with_vectors."""
    return spark.createDataFrame(list(enumerate(TEXTS, 1)), "query_id long, query string")


def asked_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus.vectors(spark, sf_dir).select((F.col("int_id") / 10).cast("long").alias("query_id"), F.col("embedding").alias("vector"), (F.col("int_id") % 10).alias("m"))
    return asked(spark, sf_dir).join(own.filter("m = 0").drop("m"), "query_id")


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, int_id): vectors of the label of the query's own vector, without that one."""
    v = corpus.vectors(spark, sf_dir).select("int_id", "label")
    q = asked(spark, sf_dir).join(v.withColumnRenamed("label", "l"), F.col("int_id") == F.col("query_id") * 10).select("query_id", "l", F.col("int_id").alias("own"))
    return v.join(corpus.listed(q), (F.col("label") == F.col("l")) & (F.col("int_id") != F.col("own"))).select("query_id", "int_id")


_built: dict[tuple, index.Stored] = {}


def stored(spark: SparkSession, sf_dir: str) -> index.Stored:
    """The index of the live documents; built at the first call of a session for these files."""
    key = (spark.sparkContext.applicationId, *sorted(corpus.table(spark, sf_dir, "documents").inputFiles()))
    if key not in _built:
        _built[key] = index.build(live(spark, sf_dir))
    return _built[key]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(corpus.store(spark, sf_dir), corpus.vectors(spark, sf_dir), lambda: stored(spark, sf_dir))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.live(corpus.store(spark, sf_dir))


def six(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


def ranks(df: DataFrame) -> DataFrame:
    return df.select("query_id", "int_id", six("score"), F.col("rank").cast("long").alias("rank"))


# sources and store ---------------------------------------------------------------------------------------------------


@query
def live_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).select("int_id", "id", "url", "title", "content_hash", "allowed_roles")


@query
def pending_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pending(corpus.store(spark, sf_dir)).select("int_id", "is_deleted", F.col("version").cast("long").alias("version"))


@query
def synth_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.synthetic(spark, 24_000)


@query
def eval_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as an evaluation set: relevant is every live document that holds the passage."""
    b = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return corpus.holding(live(spark, sf_dir).select("int_id", "content"), b)


@query
def weak_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([("the of", ["the ", "of "]), ("der die", ["der", "die"]), ("none", ["zzzz"])], "query string, keywords array<string>")
    return corpus.weak_qrels(live(spark, sf_dir), q)


@query
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(corpus.table(spark, sf_dir, "pages"))


@query
def html_extract_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(corpus.table(spark, sf_dir, "pages"), html.DOCS)


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(corpus.table(spark, sf_dir, "pages"))


@query
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.canonical(corpus.table(spark, sf_dir, "pages"))


@query
def html_files_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the file source gives them: page path and html, by document rules."""
    p = corpus.table(spark, sf_dir, "pages")
    return html.extracted(p, html.DOCS).join(p.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1).alias("url")), "page_id").select("url", "title", "content", X.sha_id(F.col("content")).alias("content_hash"))


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a web: each page also links the pages of twice its number and the next."""
    p = corpus.table(spark, sf_dir, "pages")
    target = p.select(F.col("page_id").alias("t"), F.col("url").alias("to"))
    pairs = p.select("page_id", F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("t")).join(target, "t")
    tags = pairs.groupBy("page_id").agg(F.concat_ws("", F.sort_array(F.collect_list(F.concat(F.lit('<a href="'), F.col("to"), F.lit('">next</a>'))))).alias("tags"))
    return p.join(tags, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce("tags", F.lit(""))).alias("html"))


@query
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = corpus.table(spark, sf_dir, "pages").filter("page_id = 0").select("url").first()
    return crawl.crawl(_web(spark, sf_dir), [first[0]] if first else [], max_depth=3, max_pages=100)


@query
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.table(spark, sf_dir, "pages")
    return crawl.crawl_counts(p, p.select("page_id"))


def _planted_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log by page numbers: page n links n's two children and page 0; some answers are errors, files or redirects to the next page."""
    i = F.col("page_id")
    url = lambda n: F.concat(F.lit("http://web.example.com/docs/"), n.cast("string"))
    link = lambda n: F.concat(F.lit('<a href="/docs/'), n.cast("string"), F.lit('/#top">x</a>'))
    text = F.concat(F.lit("<title>Page "), i.cast("string"), F.lit("</title><body>t "), link(2 * i + 1), link(2 * i + 2), link(F.lit(0)), F.lit("</body>"))
    status = F.when(i % 11 == 5, 404).when(i % 11 == 8, 301).otherwise(200)
    return corpus.table(spark, sf_dir, "pages").filter("page_id is not null").select(
        url(i).alias("url"), text.alias("html"), status.alias("status"), F.when(i % 13 == 6, "application/pdf").otherwise("text/html").alias("content_type"), F.when(i % 11 == 8, F.concat(F.lit("/docs/"), (i + 1).cast("string"))).alias("location"),
    )


def _robots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("web.example.com", "User-agent: *\nDisallow: /docs/3", 200)], "host string, body string, status int")


@query
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = crawl.run(_planted_web(spark, sf_dir), ["http://web.example.com/docs/0"], 3, 50, ["example.com"], _robots(spark))
    return pages.select("url", F.col("depth").cast("long").alias("depth"), "title", "content")


@query
def crawl_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a crawl request over the document store."""
    _, counts = crawl.ingest_pages(corpus.store(spark, sf_dir), _planted_web(spark, sf_dir), "http://web.example.com/docs/0", 50, 3, True, _robots(spark))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


@query
def fetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 200, 301, 404, 429, 503, 302, 200))), (e % 8 + 1).cast("int"))
    kind = F.when(e % 5 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    place = F.when(e % 3 > 0, F.lit("/next"))
    got = crawl.fetch_decision(status, kind, e * 5000, F.lit(10), e % 4, e % 7, place)
    return corpus.table(spark, sf_dir, "events").select("event_id", got.alias("decision"))


@query
def safe_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = ["127.0.0.1", "::1", "192.168.1.5", "10.0.0.1", "172.16.0.5", "169.254.169.254", "8.8.8.8", "224.0.0.1", "2606:4700::1111", "not an address"]
    return spark.createDataFrame([(c, U.is_safe_address(c)) for c in cases], "address string, safe boolean")


@query
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-delivery of changed, equal and new documents, some of them twice."""
    s = corpus.store(spark, sf_dir)
    again = s.filter("int_id % 4 < 2").select(F.col("int_id").alias("seq"), "url", "title", F.when(F.col("int_id") % 4 == 0, F.concat("content", F.lit(" updated"))).otherwise(F.col("content")).alias("content"))
    fresh = s.filter("int_id % 4 = 2").select((F.col("int_id") + 10_000_000).alias("seq"), F.concat("url", F.lit("/new")).alias("url"), "title", "content")
    repeated = fresh.select((F.col("seq") + 10_000_000).alias("seq"), "url", "title", F.lit("second delivery").alias("content"))
    out = store.upserted(s, again.unionAll(fresh).unionAll(repeated))
    return out.select("int_id", "id", "content_hash", "allowed_roles", F.col("version").cast("long").alias("version"), "is_deleted", "indexing_status", "action")


@query
def index_sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sync_stats(corpus.store(spark, sf_dir), F.col("int_id") % 50 == 0)


@query
def index_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = spark.createDataFrame([(1, "COMPLETE"), (2, "FAILED")], "version long, status string")
    n = live(spark, sf_dir).agg(F.count("*").alias("document_count"))
    return store.next_generation(versions, F.lit(0)).drop("document_count").crossJoin(n).select("version", "document_count", "status")


@query
def search_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    calls = e.select(F.col("event_id").alias("id"), F.concat(F.lit("/"), "event_type").alias("endpoint"), F.lit("lexical").alias("mode"), F.col("event_type").alias("query"), (F.col("event_id") % 50).alias("total"), (F.col("event_id") % 20).alias("returned"), F.col("value").alias("seconds"))
    get = lambda p: F.get_json_object("event", p)
    return store.search_events(calls).select(F.col("id").alias("event_id"), get("$.event").alias("event"), get("$.endpoint").alias("endpoint"), get("$.mode").alias("mode"), get("$.query_length").cast("long").alias("query_length"), get("$.total_results").cast("long").alias("total_results"), get("$.timing_ms.total").cast("double").alias("total_ms"))


@query
def parity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = live(spark, sf_dir)
    return store.parity(docs, index.tokens(docs), corpus.vectors(spark, sf_dir))


@query
def parity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.id_differences(live(spark, sf_dir), corpus.vectors(spark, sf_dir))


@query
def dup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").agg(F.count("*").alias("urls"), (F.count("*") - F.countDistinct("url")).alias("duplicates"))


@query
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).health(spark.createDataFrame([(1,), (2,)], "version long"))


@query
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.grants(spark)


# access, predicates, scalar functions --------------------------------------------------------------------------------


@query
def rbac_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.visible_by_role(corpus.store(spark, sf_dir)).select("role", "int_id")


@query
def rbac_blocked_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.blocked(corpus.store(spark, sf_dir))


@query
def rbac_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.leakage(access.visible_by_role(corpus.store(spark, sf_dir)))


@query
def url_role_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.store(spark, sf_dir).select("int_id", "url", U.assigned_role(F.upper("url")).alias("role"))


@query
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.in_domain(live(spark, sf_dir), "SRC1.example").select("int_id", "url")


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", U.normalized(F.concat(F.upper(F.substring("url", 1, 15)), F.substring(F.col("url"), F.lit(16), F.length("url")), F.lit("/?q=1#part"))).alias("url"))


@query
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query
def allowed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.store(spark, sf_dir).select("int_id", U.allowed(F.col("url"), ["src1.example.com", "example.org"]).alias("one"), U.allowed(F.col("url"), ["example.com"]).alias("below"))


@query
def safe_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("int_id")
    raw = F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.concat(F.lit("src"), i, F.lit(".example.com/a"))).when(i % 4 == 2, F.concat(F.lit("module"), i, F.lit(".py"))).otherwise(F.lit("javascript:alert(1)"))
    return corpus.store(spark, sf_dir).select("int_id", U.safe_href(raw).alias("href"))


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(live(spark, sf_dir)).select("int_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize_query(F.concat(F.lit("  "), "text", F.lit(" \t\n "))).alias("query"))


@query
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.store(spark, sf_dir).select("int_id", "id", "content_hash")


@query
def logit_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("event_id") % 10 == 0, F.lit(1.0)).when(F.col("event_id") % 10 == 1, F.lit(0.0)).otherwise((F.col("event_id") % 97) / 97.0)
    return corpus.table(spark, sf_dir, "events").select("event_id", F.round(X.logit(p), 5).alias("logit"))


@query
def crag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rerank.confidence((F.col("event_id") % 41 - 20) / 5.0)
    return corpus.table(spark, sf_dir, "events").select("event_id", F.round(c["score"], 6).alias("score"), c["status"].alias("status"))


@query
def sse_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(rerank.framed(F.lit(rerank.REFUSAL))).alias("i", "frame")).select(F.col("i").cast("long").alias("i"), "frame")


# lexical -------------------------------------------------------------------------------------------------------------


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_stats(index.tokens(live(spark, sf_dir))).select("n_docs", "total_tokens", six("avgdl"))


@query
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(index.tokens(live(spark, sf_dir))).select("term", "df", "cf")


@query
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = index.tokens(live(spark, sf_dir))
    n = index.corpus_stats(toks).select("n_docs")
    return index.term_stats(toks).crossJoin(F.broadcast(n)).select("term", F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(index.tokens(live(spark, sf_dir))).select("int_id", "term", "tf", F.array_join("positions", ",").alias("positions"))


@query
def postings_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = live(spark, sf_dir)
    left = index.without(index.postings(index.tokens(docs)), docs.filter("int_id % 4 = 2").select("int_id"))
    return left.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def lexical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.Lexical(stored(spark, sf_dir)).candidates(asked(spark, sf_dir))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(engine(spark, sf_dir).lexical_ranks(asked(spark, sf_dir), PAGE_ROLE, 10))


@query
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir).filter(F.contains("query", F.lit('"')))
    return lexical.Lexical(stored(spark, sf_dir)).scores(q).select("query_id", "int_id", six("score"))


# dense and fusion ----------------------------------------------------------------------------------------------------


@query
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.vectors(spark, sf_dir).select("int_id", dense.l2_normalized(F.transform("embedding", lambda x: x * 3.0)).alias("v"))
    return v.select("int_id", F.posexplode("v").alias("i", "x")).select("int_id", F.col("i").cast("long").alias("i"), six("x"))


@query
def cosine_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.vectors(spark, sf_dir)
    q = asked_with_vectors(spark, sf_dir).select("query_id", "vector")
    return v.crossJoin(corpus.listed(q)).select("query_id", "int_id", F.round(dense.cosine(F.col("embedding"), F.col("vector")), 6).alias("cosine"))


@query
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus.vectors(spark, sf_dir).select("label", F.col("embedding").alias("vector"), (F.col("int_id") % 2).cast("double").alias("mask"))
    return dense.mean_pooled(v, ["label"]).select(F.col("label").cast("long").alias("label"), F.posexplode("vector").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), six("x"))


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(engine(spark, sf_dir).dense_ranks(asked_with_vectors(spark, sf_dir), PAGE_ROLE, 10))


@query
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = live(spark, sf_dir).select("int_id", dense.hash_embedding("content").alias("v"))
    # outer: else Spark filters by the vectors' size first, for which the model would run a second time
    return v.select("int_id", F.posexplode_outer("v").alias("i", "x")).filter("x <> 0").select("int_id", F.col("i").cast("long").alias("i"), six("x"))


@query
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(fusion.minmax(engine(spark, sf_dir).lexical_ranks(asked(spark, sf_dir), "Admin", 100)))


@query
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(engine(spark, sf_dir).hybrid_ranks(asked_with_vectors(spark, sf_dir), "Admin", "weighted", 0.4, 100, 50))


@query
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(engine(spark, sf_dir).hybrid_ranks(asked_with_vectors(spark, sf_dir), "Admin", "rrf", 0.7, 100, 50))


@query
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).hybrid_ranks(asked_with_vectors(spark, sf_dir), PAGE_ROLE, "rrf", 0.5, 100, 10)
    return out.select("query_id", "int_id", six("score"), F.col("rank").cast("long").alias("rank"), six("lexical_score"), six("dense_score"))


@query
def alpha_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alpha, mrr, ndcg, best) for each weight of the grid."""
    e, q, rel = engine(spark, sf_dir), asked_with_vectors(spark, sf_dir), relevant(spark, sf_dir)
    alphas = [0.1, 0.3, 0.5, 0.7, 0.9]
    both = fusion.rrf_grid(e.lexical_ranks(q, "Admin", 100), e.dense_ranks(q, "Admin", 100), alphas, 50)
    keyed = lambda df, *cols: df.withColumn("query_id", F.struct("alpha", "query_id")).select("query_id", *cols)
    grid = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    rel, q = rel.select("*", grid), q.select("query_id", grid)
    per = metrics.by_query(keyed(both, "int_id", "rank"), keyed(rel, "int_id"), keyed(q), 10)
    out = per.groupBy(F.col("query_id.alpha").alias("alpha")).agg(F.round(F.avg("mrr_at_k"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
    best = out.agg(F.max_by("alpha", F.struct("mrr", -F.col("alpha"))).alias("b"))
    return out.crossJoin(best).select("alpha", "mrr", "ndcg", (F.col("alpha") == F.col("b")).alias("best"))


# results -------------------------------------------------------------------------------------------------------------


def _first(spark: SparkSession, sf_dir: str, k: int = 500) -> DataFrame:
    e = engine(spark, sf_dir)
    return results.hydrated(e.lexical_ranks(asked(spark, sf_dir), "Admin", k), e.docs)


@query
def dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.distinct_content(_first(spark, sf_dir)).select("query_id", "int_id", F.col("rank").cast("long").alias("rank"))


@query
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.page(results.distinct_content(_first(spark, sf_dir)), 7, 14).select("query_id", "int_id", F.col("place").cast("long").alias("place"), "total_results", F.col("page").cast("long").alias("page"), F.col("pages").cast("long").alias("pages"))


def _listed(df: DataFrame) -> DataFrame:
    return df.select("query_id", "int_id", F.col("place").cast("long").alias("place"), "total_results", six("score"), "title", "url", "allowed_roles", "snippet", F.concat_ws(" ", "matches").alias("matches"))


@query
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.snippet(F.col("content"), F.array(*map(F.lit, ("heat", "ndnd", "schpf", "the", "et"))))
    return live(spark, sf_dir).select("int_id", s.alias("s")).select("int_id", F.col("s.text").alias("snippet"), F.concat_ws(" ", "s.matches").alias("matches"))


@query
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(F.lit("the"), F.lit("et"), F.lit("&amp"))
    return live(spark, sf_dir).select("int_id", X.highlight(F.col("content"), terms).alias("html"))


@query
def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(engine(spark, sf_dir).search_lexical(asked(spark, sf_dir), PAGE_ROLE, 20, 0, "example.com"))


@query
def search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(engine(spark, sf_dir).search_dense(asked_with_vectors(spark, sf_dir), PAGE_ROLE, 20, 5))


@query
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(engine(spark, sf_dir).search_hybrid(asked_with_vectors(spark, sf_dir), PAGE_ROLE))


@query
def rerank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.snippet(F.col("content"), F.array(*map(F.lit, ("heat", "ndnd", "schpf", "the", "et"))))
    rows = live(spark, sf_dir).select("int_id", "title", "content", s.alias("s"))
    return rows.select("int_id", X.sha_id(X.truncated(rerank.candidate_text(F.col("title"), F.col("s.text"), F.col("content")))).alias("text_hash"))


@query
def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).search_reranked(asked_with_vectors(spark, sf_dir), PAGE_ROLE, use_reranker=True)
    return out.select("query_id", "doc_id", six("score"), F.round("rerank_score", 5).alias("rerank_score"), F.col("place").cast("long").alias("place"))


@query
def rerank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).select((F.col("int_id") % 7).alias("query_id"), F.col("int_id").alias("doc_id"), F.when(F.col("int_id") % 11 > 0, F.length("content") % 13).cast("double").alias("rerank_score"))
    return rerank.reranked(rows, 25).select("query_id", "doc_id", "rerank_score", F.col("place").cast("long").alias("place"))


@query
def crag_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked_with_vectors(spark, sf_dir)
    out = engine(spark, sf_dir).search_reranked(q, PAGE_ROLE, use_reranker=True)
    return rerank.fallback(out, q).select("query_id", F.round("overall_confidence", 5).alias("overall_confidence"), "fallback_triggered")


@query
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir)
    rows = engine(spark, sf_dir).search_lexical(q, PAGE_ROLE, 3)
    return rerank.prompts(rows, q)


# measures ------------------------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = asked_with_vectors(spark, sf_dir)
    return engine(spark, sf_dir).dense_ranks(q, "Admin", 50), relevant(spark, sf_dir), q


def _measure(name: str, column: str, k: int = 10) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.by_query(*_judged(spark, sf_dir), k).select("query_id", F.round(column, 6).alias("value"))

    run.__name__ = name
    query(run)


for _name, _column in (
    ("precision_core", "precision_core"), ("precision_eval", "precision_eval"), ("recall_core", "recall_core"), ("recall_eval", "recall_eval"),
    ("mrr_full", "mrr_full"), ("mrr_at_k", "mrr_at_k"), ("ndcg_at_k", "ndcg"),
):
    _measure(_name, _column)


@query
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(*_judged(spark, sf_dir)).select("metric", six("value"))


@query
def known_item_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = engine(spark, sf_dir), asked(spark, sf_dir)
    rows = results.hydrated(e.lexical_ranks(q, "Admin", 10), e.docs)
    return metrics.known_item(rows, F.contains("content", F.lit("heha")), q).select("query_id", six("rr"))


@query
def rerank_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = engine(spark, sf_dir), asked_with_vectors(spark, sf_dir)
    place = lambda df: df.select("query_id", "int_id", F.col("rank").alias("place"))
    return rerank.impact(place(e.lexical_ranks(q, "Admin", 50)), place(e.hybrid_ranks(q, "Admin", "rrf", 0.7, 100, 50)), relevant(spark, sf_dir), q)


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(corpus.table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])


@query
def latency_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select("event_type", six("mean"), six("p50_place"), six("p95_place"))


@query
def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select("event_type", six("median"), six("p95_place"))


@query
def latency_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).select("event_type", six("p50_linear"), six("p95_linear"))
