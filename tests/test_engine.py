"""The retrieval engine on small hand-made cases."""

from __future__ import annotations

import hashlib
import json
import math
import random
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.operators import access, dense, fusion, index, lexical, metrics, rerank, results, store
from lodestone.plans import oracles, queries
from lodestone.sources import corpus, crawl, html
from lodestone.streaming import sync_stream


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("r")).collect()]


def test_tokens(spark):
    cases = {
        "C++ and C#": ["c++", "and", "c#"], ".NET HTTP/2 UTF-8": [".net", "http/2", "utf-8"], "v1.2.3 __init__ os.path.join": ["v1.2.3", "__init__", "os.path.join"],
        "snake_case CamelCase": ["snake_case", "camelcase"], "O(n log n)": ["o", "n", "log", "n"], "ﬁnd ２": ["find", "2"], "": [], "!!!": [],
    }
    assert column(spark, list(cases), X.tokenize) == list(cases.values())


def test_text_functions(spark):
    assert column(spark, ["  a  b\t\nC ", None, ""], X.normalize_query) == ["a b C", "", ""]
    p = column(spark, [0.0, 1.0, 0.5], X.logit, "double")
    assert p[2] == 0 and p[1] == pytest.approx(-p[0]) == pytest.approx(math.log(1e9), abs=1e-6)
    assert column(spark, [0.0, 800.0, -800.0], X.sigmoid, "double") == [0.5, 1.0, 0.0]
    got = column(spark, ["a <b> Alpha"], lambda c: X.highlight(c, F.array(F.lit("alpha"), F.lit("<b>"))))
    assert got == ["a <mark>&lt;b&gt;</mark> <mark>Alpha</mark>"]


def test_snippets(spark):
    terms = F.array(F.lit("needle"), F.lit("hay"))
    one = lambda t: column(spark, [t], lambda c: X.snippet(c, terms))[0]
    assert tuple(one(None)) == ("", []) and tuple(one("")) == ("", [])
    assert one("x" * 200).text == "x" * 150 + "..." and one("short").text == "short"
    s = one("word " * 60 + "needle " + "tail " * 60)
    assert s.text.startswith("...word") and s.text.endswith("tail...") and s.matches == ["needle"] and "needle" in s.text


def plain_snippet(text, terms):
    low, n = text.lower(), len(text)
    hit = next((t for t in terms if t in low), None)
    if hit is None:
        return text[:150] + ("..." if n > 150 else ""), []
    pos = low.index(hit)
    begin, stop = max(0, pos - 75), min(n, pos + len(hit) + 75)
    space, behind = text.find(" ", begin), text.find(" ", stop)
    begin = space + 1 if begin > 0 and 0 <= space < pos else begin
    stop = behind if stop < n and behind >= 0 else stop
    cut = ("..." if begin > 0 else "") + text[begin:stop].strip() + ("..." if stop < n else "")
    return cut, [t for t in terms if t in cut.lower()]


def test_snippets_like_plain_code(spark):
    draw = random.Random(7)
    words = ["needle", "Hay", "é", "straße", "x" * 90, "a", "of", "\n", "\t", ""]
    texts = [draw.choice([" ", " ", ""]).join(draw.choices(words, k=draw.randrange(120))) for _ in range(200)]
    terms = ["needle", "hay", "of"]
    got = column(spark, texts, lambda c: X.snippet(c, F.array(*map(F.lit, terms))))
    assert [tuple(g) for g in got] == [plain_snippet(t, terms) for t in texts]


def test_snippet_computes_its_steps_once(spark):
    """A step that later ones name again is bound to a variable, not written out again: the text is put in small letters once, the snippet once."""
    s = X.snippet(F.col("c"), F.array(F.lit("a"), F.lit("b")))
    rows = spark.createDataFrame([("x a y",)], "c string").select(s.alias("s")).select("s.text", "s.matches")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2 and plan.count("instr(") <= 3


def test_rerank_text_reads_a_snippet_once(spark, tmp_path):
    """Rows whose text is hashed by rerank_text: the snippet within is computed once."""
    spark.createDataFrame([(1, "Title\nthe heat of it", "src1")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["rerank_text"](spark, str(tmp_path))
    assert rows.first()["text_hash"] == hashlib.sha256(b"Title\nTitle\nthe heat of it\nTitle\nthe heat of it").hexdigest()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("instr(") <= 3


def test_postings_are_made_within_rows(spark):
    """Only ids of several rows meet in a shuffle; rows without an id count as rows of one."""
    texts = [(1, "b a b c.d"), (2, ""), (3, "a"), (4, None)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    alone = index.postings(index.tokens(spark.createDataFrame(texts, "int_id long, content string")))
    assert "Aggregate" not in plan(alone) and "Join" not in plan(alone)
    again = [*texts, (3, "x a a"), (None, "y z"), (None, "y")]
    docs = spark.createDataFrame(again, "int_id long, content string")
    got = {(r.int_id, r.term): (r.tf, sorted(r.positions)) for r in index.postings(index.tokens(docs)).collect()}
    assert got == {
        (1, "a"): (1, [1]), (1, "b"): (2, [0, 2]), (1, "c.d"): (1, [3]), (3, "a"): (3, [0, 1, 2]), (3, "x"): (1, [0]), (None, "y"): (2, [0, 0]), (None, "z"): (1, [1]),
    }


def test_hash_embed_runs_its_model_once(spark, tmp_path):
    """One Python step a text; it gets a few texts at a time as Python objects, whatever the batch."""
    texts = [(i, "w%d x w%d" % (i, i)) for i in range(1, 90)] + [(98, None), (99, "")]
    spark.createDataFrame([(i, t, "src1") for i, t in texts], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["hash_embed"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    sums = {r.int_id: r.s for r in rows.groupBy("int_id").agg(F.round(F.sum(F.col("x") * F.col("x")), 4).alias("s")).collect()}
    assert sums == {i: 1.0 for i in range(1, 90)}

    def load():
        def model(held):
            if len(held) > 32:
                raise ValueError("too many at a time")
            return [[float(len(t))] * 3 for t in held]

        return model

    long = spark.range(100, numPartitions=1).select(dense.embedder(load, dim=3)(F.col("id").cast("string")).alias("v"))
    assert {tuple(round(x, 6) for x in r.v) for r in long.collect()} == {(0.57735,) * 3}


def test_html_steps_hold_few_pages(spark):
    """Pages of a batch are not all Python objects at once; numbers of pages stay whole beside missing ones."""
    big = 2**62 + 1
    pages = [(i, "http://e.com/", "<title>T%d</title><body>x <a href='/a%d'>y</a></body>" % (i, i)) for i in range(150)] + [(big, "http://e.com/", None), (None, "http://e.com/", "<a href='b'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.title, r.content) for r in html.extracted(df, html.DOCS).collect()}
    assert got == {i: (f"T{i}", "x y") for i in range(150)} | {big: ("", ""), None: ("", "")}
    assert {(r.page_id, r.link) for r in html.links(df).collect()} == {(i, f"http://e.com/a{i}") for i in range(150)} | {(None, "http://e.com/b")}
    assert {r.page_id for r in html.canonical(df).collect()} == set(got)


def test_index_lists_documents_by_rows_of_their_own(spark, tmp_path):
    """Documents and lengths come from one row each, not from all postings; ids of several rows are one document."""
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c"), (4, "d")], "int_id long, content string")
    built = index.build(docs, str(tmp_path / "i"))
    own = spark.read.parquet(str(tmp_path / "i" / "postings" / "part=-1"))
    assert sorted((r.int_id, r.doc_len) for r in own.collect()) == [(1, 3), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert sorted(map(tuple, built.docs.collect())) == [(1, 3), (2, 0), (3, 0), (4, 1)]
    assert sorted((r.int_id, r.term, r.tf) for r in built.postings.collect()) == [(1, "a", 2), (1, "b", 1), (4, "c", 1), (4, "d", 1)]


def test_urls(spark):
    norm = column(spark, ["HTTP://Ex.COM/a/?q=1#f", "https://ex.com", "https://ex.com/a//", "http://e.com/x#a?b"], U.normalized)
    assert norm == ["http://ex.com/a?q=1", "https://ex.com/", "https://ex.com/a/", "http://e.com/x"]
    assert column(spark, ["http://internal/7", "http://x/internal/7", "http://x/HR/dev/", "http://x/pricing/a"], U.assigned_role) == ["Admin", "Admin", "Engineering", "Finance"]
    assert column(spark, ["http://a.ex.com/", "http://ex.com", "http://bex.com"], lambda c: U.allowed(c, ["ex.com"])) == [True, True, False]
    assert column(spark, ["https://a", "site.org/x", "mod.py", "javascript:x"], U.safe_href) == ["https://a", "https://site.org/x", "#", "#"]
    for bad in ("127.0.0.1", "::1", "192.168.1.5", "10.0.0.1", "172.16.0.5", "169.254.169.254", "x"):
        assert not U.is_safe_address(bad)
    assert U.is_safe_url("http://8.8.8.8/a") and not U.is_safe_url("ftp://8.8.8.8") and not U.is_safe_url("http://name.example")
    assert U.is_safe_url("http://n.example", lambda _: ["8.8.8.8"]) and not U.is_safe_url("http://n.example", lambda _: ["8.8.8.8", "10.0.0.1"])


DOCS = [(1, "python is a language"), (2, "a database stores data"), (3, "python database drivers"), (4, "java is a language a language"), (5, None)]


@pytest.fixture(scope="module")
def lex(spark):
    return lexical.Lexical(spark.createDataFrame(DOCS, "int_id long, content string"))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string")


def plain_bm25(query, docs):
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for term in dict.fromkeys(query.split()):
        df = sum(term in t for t in toks.values())
        for i, t in toks.items():
            if tf := t.count(term):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    return out


def test_bm25(spark, lex):
    rows = lex.scores(ask(spark, "python database python", "zzz", "")).collect()
    assert {r.int_id: r.score for r in rows} == pytest.approx(plain_bm25("python database", DOCS)) and {r.query_id for r in rows} == {1}


def test_phrases(spark, lex):
    want = plain_bm25("a language", DOCS)
    got = {r.int_id: r.score for r in lex.scores(ask(spark, '"a language"')).collect()}
    assert got == pytest.approx({i: s + 10 * (i in (1, 4)) for i, s in want.items()})
    twice = {r.int_id: r.score for r in lex.scores(ask(spark, '"a language" "a language"')).collect()}
    assert twice[1] == pytest.approx(got[1] + 10)
    unknown = {r.int_id: r.score for r in lex.scores(ask(spark, '"a zzz language"')).collect()}
    assert unknown == pytest.approx(got)


def test_statistics_are_global_for_every_role(spark, lex):
    some = spark.createDataFrame([(3,)], "int_id long")
    got = lex.scores(ask(spark, "python"), some).collect()
    assert [(r.int_id, r.score) for r in got] == [(3, pytest.approx(plain_bm25("python", DOCS)[3]))]


def test_top_k_ties(spark):
    df = spark.createDataFrame([(1, 9, 1.0), (1, 2, 1.0), (1, 5, 2.0)], "query_id long, int_id long, score double")
    assert [(r.int_id, r["rank"]) for r in lexical.top_k(df, 2).orderBy("rank").collect()] == [(5, 1), (2, 2)] and lexical.top_k(df, 0).count() == 0


def test_index_maintenance(spark):
    toks = index.tokens(spark.createDataFrame(DOCS, "int_id long, content string"))
    built = index.postings(toks)
    assert {(r.tf, tuple(r.positions)) for r in built.filter("term = 'language' and int_id = 4").collect()} == {(2, (3, 5))}
    less = index.without(built, spark.createDataFrame([(4,), (77,)], "int_id long"))
    again = index.replaced(less, built.filter("int_id = 4"))
    key = lambda df: sorted((r.int_id, r.term, r.tf) for r in df.collect())
    assert key(again) == key(built) and not [k for k in key(less) if k[0] == 4]
    stats = index.corpus_stats(toks).first()
    assert (stats.n_docs, stats.total_tokens, stats.avgdl) == (5, 17, 3.4) and index.corpus_stats(toks.limit(0)).first().avgdl == 0


def ranked(spark, rows):
    return spark.createDataFrame([(1, i, float(s), k) for k, (i, s) in enumerate(rows, 1)], "query_id long, int_id long, score double, rank int")


def test_fusion(spark):
    a, b = ranked(spark, [(1, 10), (2, 5)]), ranked(spark, [(2, 0.9), (3, 0.8)])
    got = {r.int_id: (r.score, r["rank"]) for r in fusion.weighted(a, b, 0.5, 10).collect()}
    assert got == {1: (0.5, 1), 2: (0.5, 2), 3: (0.0, 3)}
    rr = {r.int_id: r.score for r in fusion.rrf(a, b, 0.7, 10).collect()}
    assert rr == pytest.approx({1: 0.7 / 61, 2: 0.7 / 62 + 0.3 / 61, 3: 0.3 / 62})
    assert [r.score for r in fusion.minmax(ranked(spark, [(1, 3)])).collect()] == [1.0]
    grid = {(r.alpha, r.int_id): r.score for r in fusion.rrf_grid(a, b, [0.7], 10).collect()}
    assert {i: s for (_, i), s in grid.items()} == pytest.approx(rr)
    for bad in (lambda: fusion.weighted(a, b, 1.5, 3), lambda: fusion.rrf(a, b, 0.5, 3, 0), lambda: fusion.fuse(a, b, "sum", 0.5, 3)):
        with pytest.raises(ValueError):
            bad()


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8])], "int_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 2.0])], "query_id long, vector array<double>")
    assert [(r.int_id, r.score) for r in dense.knn(v, q, 2).orderBy("rank").collect()] == [(2, 1.6), (3, 1.6)]
    assert dense.knn(v, q, 2, v.limit(0).select("int_id")).count() == 0
    new = dense.upserted(v, spark.createDataFrame([(2, [0.0, 1.0]), (9, [1.0])], "int_id long, embedding array<double>"), 2)
    assert {r.int_id: r.embedding for r in new.collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8]}


def test_roles_never_leak(spark):
    docs = spark.createDataFrame([(i, r, i == 4) for i, r in enumerate(["Admin", "HR", "Engineering", "Finance", "Public", "Public"])], "int_id long, allowed_roles string, is_deleted boolean")
    assert {r.int_id for r in access.visible(docs, "HR").collect()} == {1, 5} == {r.int_id for r in access.visible(docs, "HR").collect()}
    assert {r.int_id for r in access.visible(docs, "unknown").collect()} == {5}
    assert all(r.leaks == 0 for r in access.leakage(access.visible_by_role(docs)).collect())
    assert {(r.role, r.visible, r.blocked) for r in access.blocked(docs).collect()} >= {("Admin", 5, 0), ("Public", 1, 4)}


def test_results_order(spark):
    rows = spark.createDataFrame([(1, 1, 1, "h", "http://out"), (1, 2, 2, "h", "http://in"), (1, 3, 3, "g", "http://in")], "query_id long, int_id long, rank int, content_hash string, url string")
    kept = results.in_domain(results.distinct_content(rows), "IN")
    assert [r.int_id for r in kept.collect()] == [3]
    page = results.page(rows, 2, 1).orderBy("place").collect()
    assert [(r.int_id, r.total_results, r.pages) for r in page] == [(2, 3, 2), (3, 3, 2)]
    for bad in (("q", 0, 0), ("q", 5, -1), ("q" * 501, 5, 0)):
        with pytest.raises(ValueError):
            results.checked(*bad)
    assert results.checked(" a  b ", 1000, 99_999, 9999) == ("a b", 100, 10_000, 500)


def plain_measures(found, rel, k):
    hits = [i in rel for i in found[:k]]
    first = next((r for r, i in enumerate(found, 1) if i in rel), None)
    best = sum(1 / math.log2(i + 2) for i in range(min(len(rel), k)))
    return (
        sum(hits) / k, sum(hits) / len(hits) if hits else 0, len({i for i in found[:k] if i in rel}) / len(rel) if rel else 0, sum(hits) / len(rel) if rel else 0,
        1 / first if first else 0, 1 / first if first and first <= k else 0, sum(h / math.log2(i + 2) for i, h in enumerate(hits)) / best if rel else 0,
    )


def test_measures(spark):
    cases = [([1, 2, 3], {1, 3}), ([5, 5, 1], {5}), ([], {1}), ([1], set()), ([9, 8, 7, 1], {1, 2, 3, 4, 5, 6})]
    got = spark.createDataFrame([(q, i, r) for q, (f, _) in enumerate(cases) for r, i in enumerate(f, 1)], "query_id long, int_id long, rank int")
    rel = spark.createDataFrame([(q, i) for q, (_, s) in enumerate(cases) for i in s], "query_id long, int_id long")
    asked = spark.createDataFrame([(q,) for q in range(len(cases))], "query_id long")
    for k in (1, 3, 10):
        for r in metrics.by_query(got, rel, asked, k).collect():
            assert tuple(r)[1:] == pytest.approx(plain_measures(*cases[r.query_id], k)), (r, k)
    with pytest.raises(ValueError):
        metrics.by_query(got, rel, asked, 0)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=1, max_size=30))
def test_places_are_those_of_a_sorted_list(values):
    ordered = sorted(values)
    assert ordered[len(values) // 2] in values and ordered[int(len(values) * 0.95)] in values


def test_latency(spark):
    values = [5.0, 1.0, 9.0, 3.0]
    row = metrics.latency(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "v", ["k"]).first()
    assert (row.p50_place, row.p95_place, row.median, row.mean) == (5.0, 9.0, 4.0, 4.5)


def test_rerank_and_gate(spark):
    rows = spark.createDataFrame([(1, 10, 1.0), (1, 9, 1.0), (1, 3, None), (1, 4, 5.0)], "query_id long, doc_id long, rerank_score double")
    assert [r.doc_id for r in rerank.reranked(rows).orderBy("place").collect()] == [4, 10, 9, 3]
    asked = spark.createDataFrame([(1, "q"), (2, "p")], "query_id long, query string")
    gate = {r.query_id: (round(r.overall_confidence, 3), r.fallback_triggered) for r in rerank.fallback(rerank.reranked(rows), asked).collect()}
    assert gate == {1: (0.993, False), 2: (0.0, True)}
    frames = list(rerank.stream("p", lambda _: iter(["a", "</s>"])))
    assert json.loads(frames[0][6:])["token"] == "a" and frames[-1] == "data: [DONE]\n\n" and len(frames) == 2
    assert len(list(rerank.stream("p", None, True))) == len(rerank.REFUSAL.split()) + 1


PAGE = "<title> T </title><body><nav>menu</nav><main>One <b>two</b><script>x</script><p>three</main><a href=' /x#y '>l</a><a href='mailto:a'>m</a><link rel='alternate canonical' href='/c'></body>"


def test_html():
    tree = html.parse(PAGE)
    assert html.extract(tree, html.CRAWL) == ("T", "One two three")
    assert html.extract(html.parse("<title> </title><h1>Head</h1><body></body>"), html.CRAWL) == ("", "")
    assert html.extract(html.parse("<h1>He<i>ad</i></h1><div class='a body'>in</div>out"), html.CRAWL) == ("He ad", "in")
    assert html.extract(html.parse("<p>open<div class=document>kept<style>s</style>"), html.DOCS)[1] == "kept"
    assert html.resolved(" /x#y ", "http://h/a") == "http://h/x#y" and html.resolved("JavaScript:1", "http://h") is None and tree.canonical == "/c"
    assert html.extract(html.parse(None), html.CRAWL) == ("", "")


def test_crawl(spark):
    link = lambda *to: "<body>t " + "".join(f"<a href='{t}'>x</a>" for t in to) + "</body>"
    web = [(1, "http://h/a", link("/b", "/c#z", "http://other/x")), (2, "http://h/b/", link("/d", "/a")), (3, "http://h/c", link("/d")), (4, "http://h/d", link("/e")), (5, "http://h/e", link()), (6, "http://other/x", link())]
    pages = spark.createDataFrame(web, "page_id long, url string, html string")
    got = {(r.url[-1], r.depth) for r in crawl.crawl(pages, ["http://h/a"], 2, 50, ["h"]).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2)} and crawl.crawl(pages, ["http://h/a"], 2, 2, ["h"]).count() == 2
    assert crawl.robots_allow("http://h/a", "User-agent: *\nDisallow: /p") and not crawl.robots_allow("http://h/p/1", "User-agent: *\nDisallow: /p")
    assert not crawl.robots_allow("http://h/a", None, 403) and crawl.robots_allow("http://h/a", None, 500)


def test_store_upsert(spark):
    s = corpus.migrated(spark.createDataFrame([(7, X_id("http://x/1"), "http://x/1", "t", "old", "h0")], "int_id long, id string, url string, title string, content string, content_hash string"))
    batch = spark.createDataFrame([(1, "http://x/2", "t", "n"), (2, "http://x/1", "t", "new"), (3, "http://x/2", "t", "again")], "seq long, url string, title string, content string")
    got = {r.url: r for r in store.upserted(s, batch).collect()}
    assert (got["http://x/1"].action, got["http://x/1"].version, got["http://x/1"].indexing_status) == ("updated", 2, "PENDING")
    assert (got["http://x/2"].action, got["http://x/2"].int_id, got["http://x/2"].content) == ("inserted", 8, "n")
    twice = store.upserted(store.upserted(s, batch).drop("action"), batch).groupBy("action").count().collect()
    assert [tuple(r) for r in twice] == [("skipped", 2)]


def X_id(url: str) -> str:
    import hashlib

    return hashlib.sha256(url.encode()).hexdigest()


def test_eval_dataset(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"query": "q1", "relevant_docs": ["a", "b"]}, {"query": "q2", "relevant_docs": []}]))
    q, rel = corpus.eval_dataset(spark, str(tmp_path / "e.json"))
    assert q.count() == 2 and sorted(r.doc_id for r in rel.collect()) == ["a", "b"]


def test_html_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "é x.html").write_text(PAGE, "utf-8")
    rows = corpus.html_files(spark, str(tmp_path), str(tmp_path)).collect()
    assert [r.html for r in rows] == [PAGE]


def test_stream_equals_batch(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    batches = [[("put", 1, "a b"), ("put", 2, "b c")], [("delete", 1, None), ("put", 2, "c d d")], [("put", 3, "a")]]
    changes, seq = [], 0
    for n, rows in enumerate(batches):
        part = []
        for op, i, t in rows:
            seq += 1
            part.append({"seq": seq, "op": op, "int_id": i, "content": t})
        changes += part
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        sync_stream.start(spark, str(source), str(folder)).awaitTermination()
    version, docs = sync_stream.latest(spark, str(folder))
    assert version == 2 and {(r.int_id, r.content) for r in docs.collect()} == {(2, "c d d"), (3, "a")}
    sync_stream.publish(spark.createDataFrame([], sync_stream.CHANGE), 1, str(folder))
    assert sync_stream.latest(spark, str(folder))[0] == 2
    postings = spark.read.parquet(f"{folder}/postings/generation=2")
    assert {(r.int_id, r.term, r.tf) for r in postings.collect()} == {(2, "c", 1), (2, "d", 2), (3, "a", 1)}


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["live_docs", "url_normalize", "tokenize", "lexical_candidates", "dense_topk", "ndcg_at_k", "snippet", "doc_upsert", "latency_linear"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "events"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    rel = con.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    order = sorted(got.columns)
    assert order == sorted(rel.columns)
    norm = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert norm(got.select(*order).collect()) == norm(rel.select(*order).fetchall())


def test_lists_are_used_whole(spark, monkeypatch):
    from lodestone.operators import dense
    from lodestone.plans import queries
    from lodestone.sources import corpus

    n = 10_050
    items = spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit("p"), F.col("id"), F.lit(".")).alias("text"))
    text = " ".join(f"p{i}." for i in range(n))
    monkeypatch.setattr(corpus, "table", lambda *a: items)
    monkeypatch.setattr(queries, "live", lambda *a: spark.createDataFrame([(1, text)], "int_id long, content string"))
    assert queries.eval_dataset(spark, "").count() == n
    vectors = spark.createDataFrame([(1, [1.0])], "int_id long, embedding array<double>")
    assert dense.knn(vectors, spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vector")), 1).count() == n
    asked = spark.range(n).select(F.concat(F.lit("q"), F.col("id")).alias("query"), F.array(F.lit("t")).alias("keywords"))
    assert corpus.weak_qrels(spark.createDataFrame([("a", "t")], "id string, title string"), asked).count() == n


def test_stored_index_equals_the_one_on_the_fly(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame(DOCS, "int_id long, content string")
    built, plain = index.build(docs, str(tmp_path / "i")), lexical.Lexical(docs)
    key = lambda df: sorted(map(repr, df.collect()))
    q = ask(spark, "python database python", '"a language" zzz', "")
    for named in (index.NAMED, 1):
        monkeypatch.setattr(index, "NAMED", named)
        assert key(lexical.Lexical(built).scores(q)) == key(plain.scores(q)) and key(lexical.Lexical(built).candidates(q)) == key(plain.candidates(q))
    assert key(built.stats) == key(plain.stats()) and key(built.docs.select("int_id")) == key(plain.ids())
    cols = ["int_id", "term", "tf", "positions", "doc_len"]
    assert key(built.postings.select(cols)) == key(index.postings(index.tokens(docs)).select(cols))
    none = index.build(docs.limit(0), str(tmp_path / "none"))
    assert lexical.Lexical(none).scores(q).count() == 0 and none.stats.first().n_docs == 0
    parts = built.of(q.selectExpr("'python' AS term")).inputFiles()
    assert all("part=" in p for p in parts)


def test_long_phrases_are_matched_whole(spark):
    words = [f"t{i}" for i in range(1100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other", words[-1]]))], "int_id long, content string")
    got = {r.int_id: r.score for r in lexical.Lexical(docs).scores(ask(spark, f'"{" ".join(words)}"')).collect()}
    assert got[1] - got[2] == pytest.approx(5 * 1100, abs=1)


def test_places_and_percentiles(spark):
    import numpy as np

    r = random.Random(5)
    groups = {"a": [r.random() for _ in range(501)], "b": [1.0] * 40 + [9.0], "c": [float(r.randrange(5)) for _ in range(60)], "d": [3.5], "e": [1e300, -1e300, 0.0, 5.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None)]
    got = {x.k: x for x in metrics.latency(spark.createDataFrame(rows, "k string, v double").repartition(4), "v", ["k"]).collect()}
    for k, vs in groups.items():
        s = sorted(vs)
        assert (got[k].n, got[k].p50_place, got[k].p95_place) == (len(s), s[len(s) // 2], s[int(len(s) * 0.95)])
        assert (got[k].median, got[k].p95_linear) == pytest.approx((np.percentile(s, 50), np.percentile(s, 95)))


def test_crawl_policy_robots_and_counters(spark):
    link = lambda *to: "<title>T</title><body>t " + "".join(f"<a href='{t}'>x</a>" for t in to) + "</body>"
    web = [
        ("http://h/a", link("/b", "/c", "/no", "/pdf", "/gone", "/r1", "http://10.0.0.1/x", "http://other/x", "/b#again", "mailto:m"), 200, "text/html", None),
        ("http://h/b", link("/a", "/deep"), 200, "text/html", None), ("http://h/c", "<link rel='canonical' href='/b2'>" + link(), 200, "Text/HTML", None),
        ("http://h/no", link(), 200, "text/html", None), ("http://h/pdf", "x", 200, "application/pdf", None), ("http://h/gone", "", 404, "text/html", None),
        ("http://h/r1", "", 301, None, "/r2"), ("http://h/r2", "", 302, None, "http://h/end"), ("http://h/end", link(), 200, "text/html", None), ("http://h/deep", link(), 200, "text/html", None),
    ]
    pages = spark.createDataFrame(web, "url string, html string, status int, content_type string, location string")
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /no", 200)], "host string, body string, status int")
    got, counts = crawl.run(pages, ["http://h/a"], 1, 50, ["h"], robots)
    assert {(r.url, r.depth) for r in got.collect()} == {("http://h/a", 0), ("http://h/b", 1), ("http://h/b2", 1), ("http://h/end", 1)}
    assert counts == {"fetched": 4, "failed": 1, "rejected": 2, "discovered": 8, "duplicates_avoided": 1}
    assert crawl.run(pages, ["http://h/a"], 3, 2, ["h"], robots)[1]["fetched"] == 2
    loop = spark.createDataFrame([("http://h/l", "", 301, "text/html", "/l")], "url string, html string, status int, content_type string, location string")
    rows, counts = crawl.run(loop, ["http://h/l"], 1, 5)
    assert rows.count() == 0 and counts["failed"] == 1
    assert crawl.run(pages, ["http://127.0.0.1/a"], 1, 5)[1]["fetched"] == 0


def test_ingest_pages(spark):
    stored = corpus.migrated(spark.createDataFrame([(7, X_id("http://h/a"), "http://h/a", "T", "old", "h0")], "int_id long, id string, url string, title string, content string, content_hash string"))
    web = spark.createDataFrame([("http://h/a", "<title>T</title><body>one <a href='/eng/b'>x</a></body>"), ("http://h/eng/b", "<body>two</body>")], "url string, html string")
    after, said = crawl.ingest_pages(stored, web, "http://h/a", 10, 1)
    rows = {r.url: r for r in after.collect()}
    assert (said["pages_crawled"], said["pages_stored"]) == (2, 2)
    assert (rows["http://h/a"].version, rows["http://h/eng/b"].int_id, rows["http://h/eng/b"].allowed_roles) == (2, 8, "Engineering")
    assert crawl.ingest_pages(after.drop("action"), web, "http://h/a", 10, 1)[1]["pages_stored"] == 0
    for bad in (("http://h/a", 0, 1), ("http://h/a", 101, 1), ("http://h/a", 5, 4), ("http://h/a", 5, -1), ("ftp://h/a", 5, 1), ("http://127.0.0.1/", 5, 1)):
        with pytest.raises(ValueError):
            crawl.ingest_pages(stored, web, *bad)


def test_models_run_in_batches(spark):
    def load():
        return lambda texts: [[float(len(t)), 0.0] for t in texts if len(texts) <= 3]

    v = spark.createDataFrame([(i, "x" * i) for i in range(10)] + [(10, None)], "i long, t string").select("i", dense.embedder(load, 2, 3)("t").alias("v"))
    assert {r.i: r.v for r in v.collect()} == {i: [float(0 < i < 10), 0.0] for i in range(11)}

    def pairs():
        return lambda held: [0.9 if q in t else 0.1 for q, t in held if len(held) <= 4]

    s = spark.createDataFrame([("a", "b a"), ("z", "b a"), ("q", None)] * 5, "q string, t string").select("q", rerank.cross_encoder(pairs, 4)(F.col("q"), F.col("t")).alias("s"))
    assert {r.q: round(r.s, 3) for r in s.collect()} == {"a": 2.197, "z": -2.197, "q": -2.197}
    plain = {}
    for i, t in DOCS:
        import xxhash

        e = [0.0] * dense.DIM
        for w in (t or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            e[h % dense.DIM] += 1.0 if h >> 63 else -1.0
        n = max(math.sqrt(sum(x * x for x in e)), 1e-9)
        plain[i] = [x / n for x in e]
    for r in spark.createDataFrame(DOCS, "int_id long, content string").select("int_id", dense.hash_embedding("content").alias("v")).collect():
        assert r.v == pytest.approx(plain[r.int_id])


def test_query_vectors_are_remembered():
    asked = []

    def load():
        return lambda texts: asked.extend(texts) or [[3.0, 4.0]]

    encode = dense.query_encoder(load, 2)
    first = encode("a")
    first.append(9.0)
    assert encode("a") == [0.6, 0.8] and asked == ["a"]
    encode("b"), encode("c"), encode("a")
    assert asked == ["a", "b", "c", "a"]


def test_vector_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "int_id long, embedding array<double>")
    assert dense.loaded(v, 2).count() == 1 and dense.loaded(v, 3).count() == 0
    twice = spark.createDataFrame([(1, 1, [0.0, 9.0]), (2, 1, [0.0, 1.0])], "seq long, int_id long, embedding array<double>").repartition(2)
    assert [r.embedding for r in dense.upserted(v, twice, 2).collect()] == [[0.0, 1.0]]


def test_frames_quote_what_they_hold(spark):
    frames = spark.range(1).select(rerank.framed(F.lit('say "x" \\ é')).alias("f")).first().f
    assert [json.loads(f[6:])["token"] for f in frames[:-1]] == ["say ", '"x" ', "\\ ", "é "] and frames[-1] == "data: [DONE]\n\n"


def test_links_of_a_page_without_a_number(spark):
    pages = spark.createDataFrame([(None, "http://h/", "<a href='/x'>"), (2, "http://h/", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in html.links(pages).collect()] == [(None, 0, "http://h/x")]


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in ({"_id": "1", "title": "T", "text": "one"}, {"_id": "2", "title": None, "text": "two"})))
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"_id": i, "text": f"q{i}"}) for i in ("a", "b", "c")))
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t1\nb\t9\t1\nc\t2\t0\n")
    docs, asked, rel = corpus.judged_corpus(spark, *(str(tmp_path / f) for f in ("c.jsonl", "q.jsonl", "r.tsv")))
    assert sorted(r.content for r in docs.collect()) == [" two", "T one"] and [r.query_id for r in asked.collect()] == ["a"] and [tuple(r) for r in rel.collect()] == [("a", "1", 1)]
    rows = corpus.role_corpus(spark).collect()
    assert len(rows) == 100 and {r.allowed_roles for r in rows} == set(corpus.ROLES) and rows == corpus.role_corpus(spark).collect()
    ids = spark.createDataFrame([("abc",), (None,)], "t string").select(X.int64_id("t").alias("i")).collect()
    assert [r.i for r in ids] == [int.from_bytes(hashlib.blake2b(b"abc", digest_size=8).digest(), "little", signed=True), None]


def test_a_new_checkpoint_goes_on_with_an_old_folder(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n, text in enumerate(("a", "b")):
        (source / f"{n}.json").write_text(json.dumps({"seq": n, "op": "put", "int_id": n, "content": text}))
        sync_stream.start(spark, str(source), str(folder)).awaitTermination()
        shutil.rmtree(folder / "checkpoint")
        (source / f"{n}.json").unlink()
    version, docs = sync_stream.latest(spark, str(folder))
    assert version == 1 and {r.content for r in docs.collect()} == {"a", "b"}


def test_searches_agree_from_run_to_run(spark):
    from lodestone.plans.search import Engine

    docs = spark.createDataFrame([(i, f"u{i}", f"t{i}", t, f"h{i}", "Public", False) for i, t in DOCS], "int_id long, url string, title string, content string, content_hash string, allowed_roles string, is_deleted boolean")
    vectors = docs.select("int_id", dense.hash_embedding("content").alias("embedding"))
    q = ask(spark, "python database", " ", "language")
    runs = [sorted(map(repr, Engine(docs.repartition(n), vectors.repartition(n + 1)).search_hybrid(q).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and runs[0]
    e = Engine(docs, vectors)
    assert {r.query_id for r in e.dense_ranks(q, "Public").collect()} == {1, 3} and e.ready().first().ready and not Engine(docs.limit(0), vectors).ready().first().ready
