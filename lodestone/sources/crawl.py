"""Crawling as joins: a table of pages (url, html, status) stands for the web; a live fetcher can fill one."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.operators import store as S
from lodestone.sources import html as H
from lodestone.storage import cut

#: Limits of a fetch, and answers that are tried again or followed.
MAX_BYTES, MAX_TRIES, MAX_HOPS = 5 << 20, 3, 5
RETRY = (429, 500, 502, 503, 504)
REDIRECT = (301, 302, 303, 307, 308)


def fetch_decision(status: Column, content_type: Column, length: Column, body: Column, tries: Column, hops: Column, location: Column) -> Column:
    """What is done with an answer: accept, reject, fail, retry, follow or drop (a redirect without a place)."""
    return (
        F.when(status.isin(*REDIRECT), F.when(hops >= MAX_HOPS, "fail").when(location.isNull(), "drop").otherwise("follow"))
        .when(status == 200, F.when(~F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")), "reject").when((length > MAX_BYTES) | (body > MAX_BYTES), "reject").otherwise("accept"))
        .when(status.isin(*RETRY), F.when(tries >= MAX_TRIES, "fail").otherwise("retry"))
        .otherwise("fail")
    )


def robots_allow(url: str, robots: str | None, status: int = 200, agent: str = "*") -> bool:
    """401 and 403 forbid all, 200 is parsed, anything else allows all."""
    if status in (401, 403):
        return False
    if status != 200 or robots is None:
        return True
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return rules.can_fetch(agent, url)


def _log(web: DataFrame) -> DataFrame:
    """The web as a fetch log: (url, html, status, content_type, length, location), what is missing being a plain page's."""
    missing = {"status": F.lit(200), "content_type": F.lit("text/html"), "length": F.octet_length("html"), "location": F.lit(None).cast("string")}
    rows = web.select(U.normalized(F.col("url")).alias("url"), "html", *(F.col(n) if n in web.columns else c.alias(n) for n, c in missing.items()))
    return rows.groupBy("url").agg(F.min(F.struct("status", "html", "content_type", "length", "location")).alias("r")).select("url", "r.*")


def _safe(resolve: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: u is not None and U.is_safe_url(u, resolve)).astype(bool)

    return run


def _allowed_by_robots(agent: str) -> Callable[..., Column]:
    @F.pandas_udf("boolean")
    def run(urls: pd.Series, bodies: pd.Series, statuses: pd.Series) -> pd.Series:
        rows = zip(urls, bodies, statuses, strict=True)
        return pd.Series([robots_allow(u, b, 404 if pd.isna(s) else int(s), agent) for u, b, s in rows], dtype=bool)

    return run


def _listed_host(name: str) -> list[str]:
    """A host of a table of pages stands for a public one; only addresses are judged."""
    return ["8.8.8.8"]


def run(
    web: DataFrame, seeds: list[str], max_depth: int = 2, max_pages: int = 50, domains: list[str] | None = None, robots: DataFrame | None = None,
    agent: str = "*", resolve: Callable[[str], list[str]] = _listed_host,
) -> tuple[DataFrame, dict[str, int]]:
    """(url, depth, title, content) of the pages reached from the seeds, breadth first, and the counters of the crawl.

    A level is written before the next begins, and no level begins once ``max_pages`` pages are there; ties of a level go
    by url. ``web`` is (url, html) and may have status, content_type, length and location; ``robots`` is (host, body, status).
    Redirects are followed up to five times, each place checked again; a page goes by the canonical url that it names.
    Counters: fetched, failed (no answer, an error, too many redirects), rejected (robots, address, kind, size), discovered
    links of pages above the last level, and duplicates_avoided among them.
    """
    spark, safe, log = web.sparkSession, _safe(resolve), cut(_log(web), "web")
    inside = U.allowed(F.col("url"), domains or [])
    counts = dict.fromkeys(("fetched", "failed", "rejected", "discovered", "duplicates_avoided"), 0)
    level = spark.createDataFrame([(s,) for s in seeds], "url string").select(U.normalized(F.col("url")).alias("url")).filter(inside & safe(F.col("url"))).distinct()
    seen, out = cut(level, "seen"), None
    level = seen
    for depth in range(max_depth + 1):
        rows = level.select("url", F.col("url").alias("place"), F.lit(0).alias("hops"))
        if robots is None:
            rows = rows.withColumn("verdict", F.lit("go"))
        else:
            rules = robots.select(F.lower("host").alias("host_"), F.col("body").alias("body_"), F.col("status").alias("status_"))
            rows = rows.join(rules, U.host(F.col("url")) == F.col("host_"), "left")
            rows = rows.select("url", "place", "hops", F.when(_allowed_by_robots(agent)(F.col("url"), F.col("body_"), F.col("status_")), "go").otherwise("reject").alias("verdict"))
        done = None
        for _ in range(MAX_HOPS + 1):
            answers = log.withColumnRenamed("url", "at")
            met = rows.join(answers, (F.col("place") == F.col("at")) & (F.col("verdict") == "go"), "left")
            said = fetch_decision(F.col("status"), F.col("content_type"), F.col("length"), F.octet_length("html"), F.lit(MAX_TRIES), F.col("hops") + 1, F.col("location"))
            met = cut(met.select("url", "place", "hops", "html", "location", F.when(F.col("verdict") != "go", F.col("verdict")).when(F.col("at").isNull(), "fail").otherwise(said).alias("verdict")), "answers")
            ended = met.filter("verdict <> 'follow'").select("url", "place", "html", "verdict")
            done = ended if done is None else done.unionAll(ended)
            onward = met.filter("verdict = 'follow'")
            if onward.isEmpty():
                break
            to = F.when(F.col("location").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("location")).otherwise(F.concat(F.regexp_extract("place", "^[^:/?#]+://[^/?#]*", 0), F.regexp_replace("location", "^(?!/)", "/")))
            onward = onward.select("url", U.normalized(to).alias("place"), (F.col("hops") + 1).alias("hops"))
            rows = onward.withColumn("verdict", F.when(safe(F.col("place")), "go").otherwise("drop"))
        done = cut(done, "level")
        kinds = {r[0]: r[1] for r in done.groupBy("verdict").count().collect()}
        counts["failed"] += kinds.get("fail", 0) + kinds.get("retry", 0)
        counts["rejected"] += kinds.get("reject", 0)
        room = max_pages - counts["fetched"]
        good = done.filter("verdict = 'accept'").orderBy("url").limit(room).select("url", "place", "html")
        pages = cut(H.named(good).withColumn("depth", F.lit(depth)), "pages")
        n = pages.count()
        counts["fetched"] += n
        out = pages if out is None else out.unionAll(pages)
        if depth == max_depth or not n:
            break
        seen = seen.unionAll(pages.select("url")).distinct()
        found = pages.select(F.explode("links").alias("link")).select(U.normalized(F.col("link")).alias("url")).filter(safe(F.col("url")))
        found = cut(found.join(seen.withColumn("known", F.lit(True)), "url", "left").select("url", F.coalesce("known", F.lit(False)).alias("known"), inside.alias("inside")), "links")
        total, fresh, foreign = found.agg(F.count("*"), F.count_distinct(F.when(~F.col("known") & F.col("inside"), F.col("url"))), F.count_if(~F.col("known") & ~F.col("inside"))).first()
        counts["discovered"] += total
        counts["duplicates_avoided"] += total - fresh - foreign
        level = cut(found.filter("inside and not known").select("url").distinct(), "frontier")
        seen = cut(seen.unionAll(level), "seen")
        if counts["fetched"] >= max_pages:
            break
    rows = out.groupBy("url").agg(F.min(F.struct("depth", "title", "content")).alias("r")).select("url", "r.*") if out is not None else spark.createDataFrame([], "url string, depth int, title string, content string")
    return rows, counts


def crawl(pages: DataFrame, seeds: list[str], max_depth: int = 2, max_pages: int = 50, domains: list[str] | None = None, robots: DataFrame | None = None) -> DataFrame:
    """(url, depth, title, content) of a crawl, see ``run``."""
    return run(pages, seeds, max_depth, max_pages, domains, robots)[0]


def checked_request(url: str, max_pages: int, max_depth: int, resolve: Callable[[str], list[str]] = _listed_host) -> None:
    """Raise ValueError for a crawl request that is not allowed."""
    if not 1 <= max_pages <= 100:
        raise ValueError("max_pages must lie between 1 and 100")
    if not 0 <= max_depth <= 3:
        raise ValueError("max_depth must lie between 0 and 3")
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError("the scheme must be http or https")
    if not U.is_safe_url(url, resolve):
        raise ValueError("the url is not a public one")


def ingest_pages(
    store: DataFrame, web: DataFrame, url: str, max_pages: int = 20, max_depth: int = 1, same_domain_only: bool = True, robots: DataFrame | None = None,
    resolve: Callable[[str], list[str]] = _listed_host,
) -> tuple[DataFrame, dict[str, int]]:
    """The document store after a crawl request, written, with what was done with each row (action), and the answer: pages crawled, stored, and the crawl's counters."""
    checked_request(url, max_pages, max_depth, resolve)
    domains = [urlsplit(url).netloc.lower()] if same_domain_only else None
    pages, counts = run(web, [url], max_depth, max_pages, domains, robots, resolve=resolve)
    batch = pages.select((F.row_number().over(Window.orderBy("depth", "url"))).cast("long").alias("seq"), "url", "title", "content")  # at most max_pages rows
    after = cut(S.upserted(store, batch), "store")
    stored = after.filter(F.col("action").isin("inserted", "updated")).count()
    return after, {"pages_crawled": counts["fetched"], "pages_stored": stored} | counts


def crawl_counts(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row of counters of pages that were fetched already: their number, links discovered, and those met more than once; what failed or was rejected is not among such pages."""
    found = H.links(pages).agg(F.count("*").alias("discovered"), (F.count("*") - F.countDistinct("link")).alias("duplicates_avoided"))
    return fetched.agg(F.count("*").alias("fetched")).crossJoin(found).select("fetched", F.lit(0).cast("long").alias("failed"), F.lit(0).cast("long").alias("rejected"), "discovered", "duplicates_avoided")
