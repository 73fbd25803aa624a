"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from lodestone.functions import urls as U
from lodestone.functions.text import TOKEN
from lodestone.operators.access import GRANTS
from lodestone.operators.rerank import REFUSAL, SYSTEM
from lodestone.plans.queries import PAGE_ROLE, TEXTS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _role(url: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower({url}), '{'|'.join(parts)}') THEN '{role}'" for role, parts in U.ROLE_RULES)
    return f"CASE {rules} ELSE 'Public' END"


_URL = "'https://' || source || '.example.com/' || CASE doc_id % 5 WHEN 0 THEN 'eng' WHEN 1 THEN 'hr' WHEN 2 THEN 'finance' WHEN 3 THEN 'internal' ELSE 'docs' END || '/' || doc_id"
_GRANT = ", ".join(f"({_text(r)}, {_text(c)})" for r, cs in GRANTS.items() for c in cs)
_QUERY = ", ".join(f"({i}::BIGINT, {_text(t)})" for i, t in enumerate(TEXTS, 1))
_PHRASE = [(i, t.split('"')[1].split()) for i, t in enumerate(TEXTS, 1) if '"' in t]
_PHRASES = ", ".join(f"({i}::BIGINT, {_text(a)}, {_text(b)})" for i, (a, b) in _PHRASE)

CORPUS = f"""
corpus AS (SELECT doc_id AS int_id, sha256(u) AS id, u AS url, substring(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, sha256(text) AS content_hash,
  {_role("u")} AS allowed_roles, (1 + (doc_id % 3 = 0)::INT)::BIGINT AS version, doc_id % 97 = 0 AS is_deleted,
  CASE doc_id % 10 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' ELSE 'INDEXED' END AS indexing_status FROM (SELECT *, {_URL} AS u FROM documents)),
live AS (SELECT * FROM corpus WHERE NOT is_deleted),
grants(role, can_read) AS (VALUES {_GRANT}),
qry(query_id, query) AS (VALUES {_QUERY})"""
TOKENS = f"""{CORPUS},
tok AS (SELECT int_id, regexp_extract_all(lower(content), '{TOKEN}') AS tokens FROM live),
stats AS (SELECT count(*) AS n_docs, sum(len(tokens))::BIGINT AS total_tokens, sum(len(tokens)) / count(*)::DOUBLE AS avgdl FROM tok),
words AS (SELECT int_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM tok)"""
QTERMS = f"""{TOKENS},
qterm AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM qry),
post AS (SELECT int_id, term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM words WHERE term IN (SELECT term FROM qterm) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
base AS (SELECT query_id, int_id, sum(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / avgdl))) AS s
  FROM post JOIN dfs USING (term) JOIN qterm USING (term) JOIN tok USING (int_id), stats GROUP BY ALL),
phrase(query_id, a, b) AS (VALUES {_PHRASES}),
boost AS (SELECT p.query_id, x.int_id, count(*) * 10.0 AS g FROM phrase p JOIN post x ON x.term = p.a JOIN post y ON y.term = p.b AND y.int_id = x.int_id
  WHERE list_has_any(list_transform(x.positions, lambda v: v + 1), y.positions) GROUP BY ALL),
scored AS (SELECT query_id, int_id, (s + coalesce(g, 0))::DOUBLE AS score FROM base LEFT JOIN boost USING (query_id, int_id))"""
DENSE = """
vec AS (SELECT vec_id AS int_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
qvec AS (SELECT query_id, query, e AS q, label AS ql, int_id AS own FROM qry JOIN vec ON int_id = query_id * 10),
dots AS (SELECT query_id, int_id, list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * q[i])) AS score FROM vec, qvec),
rel AS (SELECT query_id, int_id FROM vec JOIN qvec ON label = ql AND int_id <> own)"""


def _visible(role: str) -> str:
    return f"SELECT int_id FROM live WHERE allowed_roles IN ({', '.join(map(_text, GRANTS[role]))})"


def _top(name: str, source: str, k: int, role: str | None = None) -> str:
    seen = f" WHERE int_id IN ({_visible(role)})" if role else ""
    return f"{name} AS (SELECT * FROM (SELECT query_id, int_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, int_id) AS rank FROM {source}{seen}) WHERE rank <= {k})"


def _minmax(name: str, source: str) -> str:
    return f"""{name} AS (SELECT query_id, int_id, rank, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END::DOUBLE AS score
  FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS hi, min(score) OVER (PARTITION BY query_id) AS lo FROM {source}))"""


def _weighted(name: str, lex: str, den: str, alpha: float) -> str:
    return f"""{_minmax("ml", lex)}, {_minmax("md", den)},
{name} AS (SELECT query_id, int_id, {alpha}::DOUBLE * coalesce(a.score, 0) + (1 - {alpha}::DOUBLE) * coalesce(b.score, 0) AS score FROM ml a FULL JOIN md b USING (query_id, int_id))"""


def _rrf(name: str, lex: str, den: str, alpha: float) -> str:
    return f"""{name} AS (SELECT query_id, int_id, sum(s) AS score FROM (SELECT query_id, int_id, {alpha}::DOUBLE / (60 + rank) AS s FROM {lex}
  UNION ALL SELECT query_id, int_id, (1 - {alpha}::DOUBLE) / (60 + rank) FROM {den}) GROUP BY ALL)"""


_RANKS = "SELECT query_id, int_id, round(score, 6) AS score, rank FROM "
#: The queries that have a vector too.
_BOTH = f"{QTERMS}, {DENSE}, lexq AS (SELECT * FROM scored WHERE query_id IN (SELECT query_id FROM qvec))"


def _snippet(content: str, terms: str) -> str:
    """SELECT list (snippet, matches) of a subquery with the columns of t and these expressions."""
    return f"""
s1 AS (SELECT *, lower(c) AS low, length(c) AS n, list_filter(terms, lambda x: contains(lower(c), x))[1] AS hit FROM (SELECT *, coalesce({content}, '') AS c, {terms} AS terms FROM t)),
s2 AS (SELECT *, instr(low, hit) - 1 AS pos FROM s1),
s3 AS (SELECT *, greatest(0, pos - 75) AS b0, least(n, pos + length(hit) + 75) AS e0 FROM s2),
s4 AS (SELECT *, instr(substring(c, b0 + 1), ' ') AS sp, instr(substring(c, e0 + 1), ' ') AS es FROM s3),
s5 AS (SELECT *, CASE WHEN b0 > 0 AND sp > 0 AND b0 + sp - 1 < pos THEN b0 + sp ELSE b0 END AS b, CASE WHEN e0 < n AND es > 0 THEN e0 + es - 1 ELSE e0 END AS e FROM s4),
s6 AS (SELECT *, CASE WHEN hit IS NULL THEN substring(c, 1, 150) || CASE WHEN n > 150 THEN '...' ELSE '' END
  ELSE CASE WHEN b > 0 THEN '...' ELSE '' END || regexp_replace(substring(c, b + 1, e - b), '^\\s+|\\s+$', '', 'g') || CASE WHEN e < n THEN '...' ELSE '' END END AS snippet FROM s5),
cut AS (SELECT *, CASE WHEN hit IS NULL THEN '' ELSE array_to_string(list_filter(terms, lambda x: contains(lower(snippet), x)), ' ') END AS matches FROM s6)"""


_TERM_LIST = f"(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT regexp_extract_all(lower(query), '{TOKEN}') AS x)) GROUP BY w))"


def _shown(ranked: str, top: int, offset: int, domain: str | None = None) -> str:
    where = f" AND contains(lower(url), '{domain}')" if domain else ""
    return f"""
hyd AS (SELECT r.*, l.content_hash, l.allowed_roles, coalesce(nullif(title, ''), 'Untitled Document') AS title, coalesce(nullif(url, ''), 'unknown-url') AS url, coalesce(content, '') AS content FROM {ranked} r JOIN live l USING (int_id)),
ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS copy FROM hyd) WHERE copy = 1{where}),
paged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, count(*) OVER (PARTITION BY query_id) AS total_results FROM ded),
t AS (SELECT * FROM paged JOIN (SELECT query_id AS qid, {_TERM_LIST} AS tl FROM qry) ON qid = query_id WHERE place > {offset} AND place <= {offset + top}),
{_snippet("content", "tl")}"""


_LISTED = "SELECT query_id, int_id, place, total_results, round(score, 6) AS score, title, url, allowed_roles, snippet, matches FROM cut"
_JUDGED = f"""WITH {CORPUS}, {DENSE}, {_top("r", "dots", 50, "Admin")},
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
m AS (SELECT q.query_id, r.int_id, r.rank, (rel.int_id IS NOT NULL)::INT AS hit, coalesce(n.n, 0) AS n FROM qvec q LEFT JOIN r USING (query_id) LEFT JOIN rel ON rel.query_id = q.query_id AND rel.int_id = r.int_id LEFT JOIN n ON n.query_id = q.query_id)"""


def _measures(k: int, name: str = "per") -> str:
    return f"""{name} AS (SELECT query_id, hits / {k}::DOUBLE AS precision_core, CASE WHEN shown > 0 THEN hits / shown::DOUBLE ELSE 0 END AS precision_eval,
  CASE WHEN n > 0 THEN found / n::DOUBLE ELSE 0 END AS recall_core, CASE WHEN n > 0 THEN hits / n::DOUBLE ELSE 0 END AS recall_eval, coalesce(1.0::DOUBLE / first, 0) AS mrr_full,
  CASE WHEN first <= {k} THEN 1.0::DOUBLE / first ELSE 0 END AS mrr_at_k,
  CASE WHEN n > 0 THEN gain / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END AS ndcg
  FROM (SELECT query_id, coalesce(sum(hit) FILTER (rank <= {k}), 0) AS hits, count(DISTINCT int_id) FILTER (rank <= {k} AND hit = 1) AS found, count(*) FILTER (rank <= {k}) AS shown, max(n) AS n,
    min(rank) FILTER (hit = 1) AS first, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= {k} AND hit = 1), 0) AS gain FROM m GROUP BY query_id))"""


_REPORT = " UNION ALL ".join(
    f"SELECT '{label}@{k}' AS metric, round(avg({column}), 6) AS value FROM per{k}" for k in (1, 5, 10) for label, column in (("Precision", "precision_eval"), ("Recall", "recall_eval"), ("MRR", "mrr_at_k"), ("nDCG", "ndcg"))
)
_ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
_GRID = f"""WITH {_BOTH}, {_top("lx", "lexq", 100, "Admin")}, {_top("dn", "dots", 100, "Admin")},
al(alpha) AS (VALUES {", ".join(f"({a}::DOUBLE)" for a in _ALPHAS)}),
fu AS (SELECT alpha, query_id, int_id, sum(s) AS score FROM (SELECT alpha, query_id, int_id, alpha / (60 + rank) AS s FROM lx, al UNION ALL SELECT alpha, query_id, int_id, (1 - alpha) / (60 + rank) FROM dn, al) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(score, 10) DESC, int_id) AS rank FROM fu),
nn AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
pq AS (SELECT alpha, q.query_id, min(rank) AS first, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= 10), 0) AS gain, max(coalesce(n, 0)) AS n
  FROM al CROSS JOIN qvec q LEFT JOIN (SELECT alpha AS ra, rk.query_id AS rq, rank FROM rk JOIN rel USING (query_id, int_id) WHERE rank <= 50) ON ra = alpha AND rq = q.query_id LEFT JOIN nn ON nn.query_id = q.query_id GROUP BY ALL),
me AS (SELECT alpha, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr,
  round(avg(CASE WHEN n > 0 THEN gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END), 6) AS ndcg FROM pq GROUP BY alpha)
SELECT alpha, mrr, ndcg, alpha = (SELECT alpha FROM me ORDER BY mrr DESC, alpha LIMIT 1) AS best FROM me"""
_EVENT_P = """(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"""
_UPSERT = f"""WITH {CORPUS},
batch AS (SELECT int_id AS seq, url, title, CASE WHEN int_id % 4 = 0 THEN content || ' updated' ELSE content END AS content FROM corpus WHERE int_id % 4 < 2
  UNION ALL SELECT int_id + 10000000, url || '/new', title, content FROM corpus WHERE int_id % 4 = 2 UNION ALL SELECT int_id + 20000000, url || '/new', title, 'second delivery' FROM corpus WHERE int_id % 4 = 2),
f AS (SELECT seq, sha256(url) AS id, sha256(content) AS h, {_role("url")} AS r FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM batch) WHERE n = 1),
j AS (SELECT c.int_id, coalesce(c.id, f.id) AS id, c.content_hash, c.allowed_roles, c.version, c.is_deleted, c.indexing_status, f.seq, f.h, f.r,
  CASE WHEN f.id IS NULL THEN 'kept' WHEN c.id IS NULL THEN 'inserted' WHEN c.content_hash = f.h AND c.allowed_roles = f.r AND NOT c.is_deleted THEN 'skipped' ELSE 'updated' END AS action FROM corpus c FULL JOIN f USING (id))
SELECT coalesce(int_id, (SELECT max(int_id) FROM corpus) + row_number() OVER (PARTITION BY action ORDER BY seq)) AS int_id, id,
  CASE WHEN action IN ('inserted', 'updated') THEN h ELSE content_hash END AS content_hash, CASE WHEN action IN ('inserted', 'updated') THEN r ELSE allowed_roles END AS allowed_roles,
  CASE action WHEN 'inserted' THEN 1 WHEN 'updated' THEN version + 1 ELSE version END::BIGINT AS version, CASE WHEN action IN ('inserted', 'updated') THEN false ELSE is_deleted END AS is_deleted,
  CASE WHEN action IN ('inserted', 'updated') THEN 'PENDING' ELSE indexing_status END AS indexing_status, action FROM j"""
#: The planted web level by level: pages answered at each depth (redirects lead to the next page), and links met there.
_WEB = """web AS (SELECT page_id AS n, CASE WHEN page_id % 11 = 5 THEN 404 WHEN page_id % 11 = 8 THEN 301 ELSE 200 END AS st, page_id % 13 = 6 AS file FROM pages),
l0 AS (SELECT 0::BIGINT AS n)"""


def _level(d: int) -> str:
    """Tables of depth d: answers (verdict, page), pages, links, and the next frontier."""
    seen = " UNION ".join(f"SELECT n FROM l{k} UNION SELECT n FROM p{k}" for k in range(d + 1))
    return f"""
h{d} AS (SELECT l.n, CASE WHEN w.st = 301 THEN l.n + 1 ELSE l.n END AS place, starts_with(l.n::VARCHAR, '3') AS barred FROM l{d} l LEFT JOIN web w USING (n)),
a{d} AS (SELECT h.place, CASE WHEN barred THEN 'reject' WHEN w.n IS NULL OR w.st <> 200 THEN 'fail' WHEN w.file THEN 'reject' ELSE 'accept' END AS verdict FROM h{d} h LEFT JOIN web w ON w.n = h.place),
p{d} AS (SELECT place AS n FROM a{d} WHERE verdict = 'accept'),
k{d} AS (SELECT unnest([2 * n + 1, 2 * n + 2, 0]) AS n FROM p{d}),
s{d} AS ({seen}),
l{d + 1} AS (SELECT DISTINCT n FROM k{d} WHERE n NOT IN (SELECT n FROM s{d}))"""


_CRAWLED = f"WITH {_WEB},{','.join(_level(d) for d in range(4))}"
_DEPTHS = " UNION ALL ".join(f"SELECT n, {d}::BIGINT AS depth FROM p{d}" for d in range(4))
_ANSWERS = " UNION ALL ".join(f"SELECT verdict FROM a{d}" for d in range(4))
_MET = " UNION ALL ".join(f"SELECT (SELECT count(*) FROM k{d}) AS met, (SELECT count(*) FROM l{d + 1}) AS fresh" for d in range(3))
_ESCAPED = "replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
_PRUNED = f"""WITH {_BOTH}, {_top("lx", "lexq", 500, PAGE_ROLE)}, {_top("dn", "dots", 500, PAGE_ROLE)}, {_weighted("fu", "lx", "dn", 0.4)}, {_top("rk", "fu", 150)}, {_shown("rk", 15, 0)},
p AS (SELECT *, regexp_extract_all(lower(substring(title || chr(10) || snippet || chr(10) || content, 1, 4000)), '{TOKEN}') AS tx FROM cut),
sh AS (SELECT *, least(greatest(len(list_intersect(tl, tx)) / greatest(len(tl), 1)::DOUBLE, 1e-9), 1 - 1e-9) AS pr FROM p),
rr AS (SELECT *, ln(pr / (1 - pr)) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY ln(pr / (1 - pr)) DESC NULLS LAST, int_id::VARCHAR) AS np FROM sh)"""
_HREF = f"""CASE WHEN regexp_matches(u, '^https?://') THEN u WHEN regexp_matches(u, '^[a-zA-Z0-9][a-zA-Z0-9-]{{1,61}}[a-zA-Z0-9]\\.[a-zA-Z]{{2,}}(/.*)?$') AND NOT regexp_matches(u, '(?i)\\.({U.FILE_ENDINGS})$') THEN 'https://' || u ELSE '#' END"""
_FRAMES = [f'data: {{"token": "{w} "}}\n\n' for w in REFUSAL.split()] + ["data: [DONE]\n\n"]
_CTE = f"WITH {CORPUS} "

ORACLES: dict[str, str] = {
    "live_docs": _CTE + "SELECT int_id, id, url, title, content_hash, allowed_roles FROM live",
    "pending_docs": _CTE + "SELECT int_id, is_deleted, version FROM corpus WHERE indexing_status = 'PENDING'",
    "synth_corpus": """SELECT i AS int_id, 'doc_' || i AS id, 'http://internal/' || i AS url, 'Scale Document ' || i AS title, 'This is a massive scale test document. Index ' || i || '. Relevant to ' || r || '.' AS content,
  'hash_' || i AS content_hash, r AS allowed_roles, 'PENDING' AS indexing_status FROM (SELECT i, ['Admin', 'HR', 'Engineering', 'Public', 'Finance'][i % 5 + 1] AS r FROM range(24000) t(i))""",
    "eval_dataset": _CTE + "SELECT item_id AS query_id, int_id FROM live JOIN benchmark ON contains(content, text)",
    "weak_qrels": _CTE + "SELECT DISTINCT query, id FROM live JOIN (VALUES ('the of', 'the '), ('the of', 'of '), ('der die', 'der'), ('der die', 'die'), ('none', 'zzzz')) k(query, kw) ON contains(lower(coalesce(title, '')), kw)",
    "crawl_pages": _CRAWLED + f" SELECT 'http://web.example.com/docs/' || n AS url, min(depth) AS depth, 'Page ' || n AS title, 't x x x' AS content FROM ({_DEPTHS}) GROUP BY n",
    "crawl_ingest": _CRAWLED
    + f""" SELECT (SELECT count(*) FROM ({_DEPTHS})) AS pages_crawled, (SELECT count(DISTINCT n) FROM ({_DEPTHS})) AS pages_stored, (SELECT count(*) FROM ({_DEPTHS})) AS fetched,
  count(*) FILTER (verdict = 'fail') AS failed, count(*) FILTER (verdict = 'reject') AS rejected, (SELECT sum(met)::BIGINT FROM ({_MET})) AS discovered, (SELECT (sum(met) - sum(fresh))::BIGINT FROM ({_MET})) AS duplicates_avoided FROM ({_ANSWERS})""",
    "safe_ip": "SELECT * FROM (VALUES ('127.0.0.1', false), ('::1', false), ('192.168.1.5', false), ('10.0.0.1', false), ('172.16.0.5', false), ('169.254.169.254', false), ('8.8.8.8', true), ('224.0.0.1', false), ('2606:4700::1111', true), ('not an address', false)) t(address, safe)",
    "fetch_policy": """SELECT event_id, CASE WHEN st IN (301, 302) THEN CASE WHEN event_id % 7 >= 5 THEN 'fail' WHEN event_id % 3 = 0 THEN 'drop' ELSE 'follow' END
  WHEN st = 200 THEN CASE WHEN event_id % 5 = 0 THEN 'reject' WHEN event_id * 5000 > 5242880 THEN 'reject' ELSE 'accept' END WHEN st IN (429, 503) THEN CASE WHEN event_id % 4 >= 3 THEN 'fail' ELSE 'retry' END ELSE 'fail' END AS decision
  FROM (SELECT event_id, [200, 200, 301, 404, 429, 503, 302, 200][event_id % 8 + 1] AS st FROM events)""",
    "doc_upsert": _UPSERT,
    "index_sync_stats": _CTE
    + """SELECT count(*) FILTER (NOT is_deleted AND version = 1 AND int_id % 50 <> 0) AS added, count(*) FILTER (NOT is_deleted AND version <> 1 AND int_id % 50 <> 0) AS updated,
  count(*) FILTER (is_deleted) AS deleted, count(*) FILTER (NOT is_deleted AND int_id % 50 = 0) AS failed, 0::BIGINT AS skipped FROM corpus WHERE indexing_status = 'PENDING'""",
    "index_generation": _CTE + "SELECT 3::BIGINT AS version, count(*) AS document_count, 'COMPLETE' AS status FROM live",
    "search_log_events": "SELECT event_id, 'search_request' AS event, '/' || event_type AS endpoint, 'lexical' AS mode, length(event_type) AS query_length, event_id % 50 AS total_results, round(value * 1000, 2) AS total_ms FROM events",
    "parity_counts": _CTE + "SELECT db, lexical, dense, db = lexical AND db = dense AS parity_ok FROM (SELECT (SELECT count(*) FROM live) AS db, (SELECT count(*) FROM live) AS lexical, (SELECT count(*) FROM embeddings) AS dense)",
    "parity_ids": _CTE + "SELECT count(*) FILTER (v IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l IS NOT NULL AND v IS NOT NULL) AS both FROM (SELECT int_id AS l FROM live) FULL JOIN (SELECT vec_id AS v FROM embeddings) ON l = v",
    "dup_urls": "SELECT count(*) AS urls, count(*) - count(DISTINCT url) AS duplicates FROM pages",
    "health": _CTE
    + """SELECT 'ok' AS status, CASE WHEN db = dense THEN 'healthy' ELSE 'degraded' END AS logged_status, db AS db_doc_count, db AS lexical_doc_count, dense AS dense_doc_count, db = dense AS parity_ok, 2::BIGINT AS index_generation
  FROM (SELECT (SELECT count(*) FROM live) AS db, (SELECT count(*) FROM embeddings) AS dense)""",
    "roles": f"SELECT * FROM (VALUES {_GRANT}) t(role, can_read)",
    "rbac_visible": _CTE + "SELECT role, int_id FROM live JOIN grants ON allowed_roles = can_read",
    "rbac_blocked_count": _CTE + "SELECT role, count(*) FILTER (can_read IS NOT NULL) AS visible, count(*) FILTER (can_read IS NULL) AS blocked FROM (SELECT r.role, g.can_read FROM live CROSS JOIN (SELECT DISTINCT role FROM grants) r LEFT JOIN grants g ON g.role = r.role AND g.can_read = allowed_roles) GROUP BY role",
    "rbac_leakage": _CTE + "SELECT role, count(*) AS checked, count(*) FILTER (role <> 'Admin' AND allowed_roles <> role AND allowed_roles <> 'Public') AS leaks FROM live JOIN grants ON allowed_roles = can_read GROUP BY role",
    "url_role_assign": _CTE + f"SELECT int_id, url, {_role('url')} AS role FROM corpus",
    "domain_filter": _CTE + "SELECT int_id, url FROM live WHERE contains(lower(url), 'src1.example')",
    "url_normalize": r"""SELECT page_id, lower(s) || '://' || lower(h) || CASE WHEN p2 = '' THEN '/' ELSE p2 END || q AS url FROM (SELECT page_id, s, h, regexp_replace(p, '/$', '') AS p2, q FROM (
  SELECT page_id, regexp_extract(u, '^([^:/?#]+)://', 1) AS s, regexp_extract(u, '://([^/?#]*)', 1) AS h, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS q
  FROM (SELECT page_id, upper(substring(url, 1, 15)) || substring(url, 16) || '/?q=1#part' AS u FROM pages)))""",
    "url_host": "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages",
    "allowed_domain": _CTE + "SELECT int_id, host = 'src1.example.com' AS one, host LIKE '%.example.com' AS below FROM (SELECT int_id, regexp_extract(url, '://([^/]*)', 1) AS host FROM corpus)",
    "safe_href": _CTE + f"SELECT int_id, {_HREF} AS href FROM (SELECT int_id, CASE int_id % 4 WHEN 0 THEN url WHEN 1 THEN 'src' || int_id || '.example.com/a' WHEN 2 THEN 'module' || int_id || '.py' ELSE 'javascript:alert(1)' END AS u FROM corpus)",
    "tokenize": f"WITH {TOKENS} SELECT int_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM tok",
    "normalize_query": "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query FROM conversations",
    "doc_ids": _CTE + "SELECT int_id, id, content_hash FROM corpus",
    "logit_clamp": "SELECT event_id, round(ln(c / (1 - c)), 5) AS logit FROM (SELECT event_id, least(greatest(CASE event_id % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE (event_id % 97) / 97.0::DOUBLE END::DOUBLE, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS c FROM events)",
    "crag_status": "SELECT event_id, round(p, 6) AS score, CASE WHEN p >= 0.75 THEN 'CORRECT' WHEN p >= 0.30 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS status FROM (SELECT event_id, 1 / (1 + exp(-(event_id % 41 - 20) / 5.0::DOUBLE)) AS p FROM events)",
    "sse_fallback": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_text(f)})" for i, f in enumerate(_FRAMES)) + ") t(i, frame)",
    "corpus_stats": f"WITH {TOKENS} SELECT n_docs, total_tokens, round(avgdl, 6) AS avgdl FROM stats",
    "term_df": f"WITH {TOKENS} SELECT term, count(DISTINCT int_id) AS df, count(*) AS cf FROM words GROUP BY term",
    "term_idf": f"WITH {TOKENS} SELECT term, round(ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM (SELECT term, count(DISTINCT int_id) AS df FROM words GROUP BY term), stats",
    "postings_build": f"WITH {TOKENS} SELECT int_id, term, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM words GROUP BY int_id, term",
    "postings_delete": f"WITH {TOKENS} SELECT term, count(DISTINCT int_id) AS df, count(*) AS cf FROM words WHERE int_id % 4 <> 2 GROUP BY term",
    "lexical_candidates": f"WITH {QTERMS} SELECT query_id, int_id FROM base",
    "bm25_topk": f"WITH {QTERMS}, {_top('r', 'scored', 10, PAGE_ROLE)} {_RANKS} r",
    "bm25_phrase": f"WITH {QTERMS} SELECT query_id, int_id, round(score, 6) AS score FROM scored WHERE query_id IN (SELECT query_id FROM phrase)",
    "l2_normalize": "SELECT int_id, unnest(range(len(v))) AS i, unnest(list_transform(v, lambda x: round(x / s, 6))) AS x FROM (SELECT vec_id AS int_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3.0::DOUBLE) AS v FROM embeddings))",
    "cosine_sim": f"WITH {CORPUS}, {DENSE} SELECT query_id, int_id, round(score / (sqrt(list_sum(list_transform(v.e, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 6) AS cosine FROM dots JOIN vec v USING (int_id) JOIN qvec USING (query_id)",
    "mean_pool": "SELECT label::BIGINT AS label, i, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS x FROM (SELECT label, (vec_id % 2)::DOUBLE AS m, unnest(range(len(embedding))) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x FROM embeddings) GROUP BY label, i",
    "dense_topk": f"WITH {CORPUS}, {DENSE}, {_top('r', 'dots', 10, PAGE_ROLE)} {_RANKS} r",
    "minmax_norm": f"WITH {QTERMS}, {_top('r', 'scored', 100, 'Admin')}, {_minmax('m', 'r')} {_RANKS} m",
    "hybrid_weighted": f"WITH {_BOTH}, {_top('lx', 'lexq', 100, 'Admin')}, {_top('dn', 'dots', 100, 'Admin')}, {_weighted('fu', 'lx', 'dn', 0.4)}, {_top('r', 'fu', 50)} {_RANKS} r",
    "hybrid_rrf": f"WITH {_BOTH}, {_top('lx', 'lexq', 100, 'Admin')}, {_top('dn', 'dots', 100, 'Admin')}, {_rrf('fu', 'lx', 'dn', 0.7)}, {_top('r', 'fu', 50)} {_RANKS} r",
    "hybrid_search": f"WITH {_BOTH}, {_top('lx', 'lexq', 100, PAGE_ROLE)}, {_top('dn', 'dots', 100, PAGE_ROLE)}, {_rrf('fu', 'lx', 'dn', 0.5)}, {_top('r', 'fu', 10)} SELECT r.query_id, r.int_id, round(r.score, 6) AS score, r.rank, round(lx.score, 6) AS lexical_score, round(dn.score, 6) AS dense_score FROM r LEFT JOIN lx USING (query_id, int_id) LEFT JOIN dn USING (query_id, int_id)",
    "alpha_grid": _GRID,
    "dedup_by_hash": f"WITH {QTERMS}, {_top('rk', 'scored', 500, 'Admin')}, {_shown('rk', 10000, 0)} SELECT query_id, int_id, rank FROM ded",
    "paginate": f"WITH {QTERMS}, {_top('rk', 'scored', 500, 'Admin')}, {_shown('rk', 7, 14)} SELECT query_id, int_id, place, total_results, 3::BIGINT AS page, ceil(total_results / 7.0)::BIGINT AS pages FROM t",
    "snippet": f"WITH {CORPUS}, t AS (SELECT * FROM live), {_snippet('content', "['heat', 'ndnd', 'schpf', 'the', 'et']")} SELECT int_id, snippet, matches FROM cut",
    "highlight": _CTE + f"SELECT int_id, regexp_replace({_ESCAPED}, '(the|et|&amp;amp)', '<mark>\\1</mark>', 'gi') AS html FROM live",
    "search_lexical": f"WITH {QTERMS}, {_top('rk', 'scored', 500, PAGE_ROLE)}, {_shown('rk', 20, 0, 'example.com')} {_LISTED}",
    "search_dense": f"WITH {CORPUS}, {DENSE}, {_top('rk', 'dots', 500, PAGE_ROLE)}, {_shown('rk', 20, 5)} {_LISTED}",
    "search_hybrid": f"WITH {_BOTH}, {_top('lx', 'lexq', 500, PAGE_ROLE)}, {_top('dn', 'dots', 500, PAGE_ROLE)}, {_weighted('fu', 'lx', 'dn', 0.4)}, {_top('rk', 'fu', 500)}, {_shown('rk', 20, 0)} {_LISTED}",
    "rerank_text": f"WITH {CORPUS}, t AS (SELECT * FROM live), {_snippet('content', "['heat', 'ndnd', 'schpf', 'the', 'et']")} SELECT int_id, sha256(substring(title || chr(10) || snippet || chr(10) || content, 1, 4000)) AS text_hash FROM cut",
    "search_reranked": _PRUNED + " SELECT query_id, int_id AS doc_id, round(score, 6) AS score, round(rerank_score, 5) AS rerank_score, np AS place FROM rr WHERE np <= 10",
    "rerank_sort": _CTE + "SELECT * FROM (SELECT int_id % 7 AS query_id, int_id AS doc_id, s AS rerank_score, row_number() OVER (PARTITION BY int_id % 7 ORDER BY s DESC NULLS LAST, int_id::VARCHAR) AS place FROM (SELECT int_id, CASE WHEN int_id % 11 > 0 THEN (length(content) % 13)::DOUBLE END AS s FROM live)) WHERE place <= 25",
    "crag_fallback": _PRUNED + ", c AS (SELECT q.query_id, coalesce(1 / (1 + exp(-rerank_score)), 0) AS p FROM qvec q LEFT JOIN (SELECT * FROM rr WHERE np = 1) USING (query_id)) SELECT query_id, round(p, 5) AS overall_confidence, p < 0.3 AS fallback_triggered FROM c",
    "rag_prompt": f"WITH {QTERMS}, {_top('rk', 'scored', 500, PAGE_ROLE)}, {_shown('rk', 3, 0)}, g AS (SELECT query_id, string_agg('Document [' || place || '] (' || title || '): ' || snippet, chr(10) || chr(10) ORDER BY place) AS ctx FROM cut GROUP BY query_id) "
    f"SELECT query_id, {_text(f'<|system|>{chr(10)}{SYSTEM}</s>{chr(10)}<|user|>{chr(10)}Context:{chr(10)}')} || coalesce(ctx, '') || {_text(f'{chr(10)}{chr(10)}Query: ')} || query || {_text(f'</s>{chr(10)}<|assistant|>{chr(10)}')} AS prompt FROM qry LEFT JOIN g USING (query_id)",
    "eval_report": f"{_JUDGED}, {', '.join(_measures(k, f'per{k}') for k in (1, 5, 10))} {_REPORT}",
    "known_item_mrr": f"WITH {QTERMS}, {_top('r', 'scored', 10, 'Admin')} SELECT q.query_id, round(coalesce(1.0::DOUBLE / min(rank) FILTER (contains(content, 'heha')), 0), 6) AS rr FROM qry q LEFT JOIN r USING (query_id) LEFT JOIN live USING (int_id) GROUP BY q.query_id",
    "rerank_impact": f"""WITH {_BOTH}, {_top('b', 'lexq', 50, 'Admin')}, {_top('lx', 'lexq', 100, 'Admin')}, {_top('dn', 'dots', 100, 'Admin')}, {_rrf('fu', 'lx', 'dn', 0.7)}, {_top('a', 'fu', 50)},
f AS (SELECT q.query_id, coalesce((SELECT min(rank) FROM b JOIN rel USING (query_id, int_id) WHERE b.query_id = q.query_id), 1e18) AS b, coalesce((SELECT min(rank) FROM a JOIN rel USING (query_id, int_id) WHERE a.query_id = q.query_id), 1e18) AS a FROM qvec q)
SELECT count(*) FILTER (a < b) AS improved, count(*) FILTER (a > b) AS degraded, count(*) FILTER (a = b) AS same FROM f""",
    "latency_runner": f"SELECT event_type, round(avg(value), 6) AS mean, round(max(value) FILTER (i = n // 2), 6) AS p50_place, round(max(value) FILTER (i = floor(n * 0.95::DOUBLE)), 6) AS p95_place FROM {_EVENT_P} GROUP BY event_type",
    "latency_profile": f"SELECT event_type, round(median(value), 6) AS median, round(max(value) FILTER (i = floor(n * 0.95::DOUBLE)), 6) AS p95_place FROM {_EVENT_P} GROUP BY event_type",
    "latency_linear": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50_linear, round(quantile_cont(value, 0.95), 6) AS p95_linear FROM events GROUP BY event_type",
}
for _name, _column in (("precision_core",) * 2, ("precision_eval",) * 2, ("recall_core",) * 2, ("recall_eval",) * 2, ("mrr_full",) * 2, ("mrr_at_k",) * 2, ("ndcg_at_k", "ndcg")):
    ORACLES[_name] = f"{_JUDGED}, {_measures(10)} SELECT query_id, round({_column}, 6) AS value FROM per"
