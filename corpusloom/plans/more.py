"""More registered queries: scores, names, joins and windows of the crawl engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import contacts, dom, links, pages, retrieval, scoring
from ..session import table
from .catalog import _CONTAINS, _EDGES, _KIND, _L, _P, _REG, _TIER, SQL, _in, _list, query

_SCORE = " + ".join(f"CASE WHEN list_contains(toks, '{k}')" + (f" OR contains(lower(path), '{k}')" if "-" in k else "") + f" THEN {w} ELSE 0 END" for k, w in scoring.INTENT.items())


@query(f"WITH {_P} SELECT page_id, CAST({_SCORE} - CASE WHEN list_has_any(toks, {_list(scoring.LOW_INTENT)}) THEN 40 ELSE 0 END - greatest(len(segs) - 1, 0) AS INTEGER) AS score FROM n")
def q_score_url(spark, d):
    return table(spark, d, "pages").select("page_id", scoring.score_url(F.col("url")).alias("score"))


@query(f"WITH {_P}{_L} SELECT page_id, scheme NOT IN ('http', 'https') OR {_REG} <> 'example.com' OR " + " OR ".join(f"lower(path) LIKE '%{e}'" for e in scoring.JUNK_ENDS) + " OR " + " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in scoring.JUNK_HOSTS) + f" OR list_has_any(toks, {_list(scoring.JUNK_TOKENS)}) AS junk FROM l")
def q_junk(spark, d):
    return table(spark, d, "pages").select("page_id", scoring.is_junk(F.col("url"), F.lit("example.com")).alias("junk"))


@query(f"WITH {_P} SELECT page_id, string_split(host, '.')[1] IN {_in(scoring.NOISE_LABELS)} OR {_CONTAINS('lower(path)', scoring.NOISE_PARTS)} OR len(regexp_extract_all(string_split(regexp_replace(lower(path), '/+$', ''), '/')[-1], '-')) >= 5 OR regexp_matches(lower(path), '^/(19|20)[0-9]{{2}}(/|$)') AS noise FROM n")
def q_crawl_noise(spark, d):
    return table(spark, d, "pages").select("page_id", scoring.is_crawl_noise(F.col("url")).alias("noise"))


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


_HITS = lambda words: f"len(list_filter(ws, lambda x: x IN ({words})))"
_LANGUAGES = {
    "en": "'the','and','of','to','is','for','in','on','with','are','this','your','our','we','you','from','as','at','by'", "it": "'il','la','di','che','per','un','una','sono','questo','nel','della','con','non','sei','gli'",
    "fr": "'le','la','de','et','pour','un','une','les','des','est','dans','que','vous','nous'", "de": "'der','die','das','und','ist','für','mit','nicht','ein','eine','sie','auf','wir'",
    "es": "'el','la','de','que','para','un','una','los','las','es','en','con','no','nosotros'", "pt": "'o','a','de','que','para','um','uma','os','as','em','com','não','nós'",
}


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]+') AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, " + ", ".join(f"{_HITS(w)} AS n_{k}" for k, w in _LANGUAGES.items()) + " FROM w) SELECT doc_id, n >= 20 AND (" + " OR ".join(f"(n_{k} >= 5 AND 2 * n_{k} > 3 * n_en)" for k in ("it", "fr", "de", "es", "pt")) + ") AS foreign_text FROM c")
def q_non_english(spark, d):
    return table(spark, d, "documents").select("doc_id", scoring.is_non_english(F.lit(""), F.col("text")).alias("foreign_text"))


_NAME = r"left(CASE WHEN coalesce(regexp_replace(lower(regexp_replace(string_split(regexp_replace(path, '/+$', ''), '/')[-1], '[^A-Za-z0-9._-]+', '-', 'g')), '^-+|-+$', '', 'g'), '') = '' THEN 'home' ELSE regexp_replace(lower(regexp_replace(string_split(regexp_replace(path, '/+$', ''), '/')[-1], '[^A-Za-z0-9._-]+', '-', 'g')), '^-+|-+$', '', 'g') END, 120)"


@query(f"WITH {_P}, m AS (SELECT page_id, host, {_NAME} AS name FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY host, name ORDER BY page_id) AS k FROM m) SELECT page_id, host, name, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS unique_name FROM r")
def q_unique_names(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), scoring.page_name(F.col("url")).alias("name"))
    return scoring.unique_names(rows, "host", "name", "page_id")


@query("WITH w AS (SELECT c_custkey, regexp_extract_all(lower(c_name || ' & ' || c_mktsegment), '[a-z0-9]+') AS ws FROM customer) SELECT c_custkey, array_to_string(ws, '-') || '|' || array_to_string(ws, '') || '|' || ws[1] AS slugs FROM w")
def q_slugs(spark, d):
    name = F.concat("c_name", F.lit(" & "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.array_join(scoring.slugs(name), "|").alias("slugs"))


@query("WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part) SELECT p_partkey, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM w")
def q_token_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(scoring.token_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query()
def q_title_confidence(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(scoring.title_confidence(F.col("p_name"), F.col("p_type")), 6).alias("confidence"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS o, max(value) AS r FROM events GROUP BY 1, 2) SELECT user_id, min(o) AS event_id, string_agg(event_type, ',' ORDER BY o) AS sources, max(r) AS value FROM f GROUP BY 1")
def q_queue_merge(spark, d):
    return scoring.merge_queue(table(spark, d, "events"), "user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])(the[^a-z0-9](.{0,20}[^a-z0-9])?of|of[^a-z0-9](.{0,20}[^a-z0-9])?the)([^a-z0-9]|$)') AS near_words FROM documents")
def q_proximity(spark, d):
    return table(spark, d, "documents").select("doc_id", scoring.near(F.col("text"), "the", "of", 20).alias("near_words"))


@query("WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT source, doc_id, n_chars FROM r WHERE total <= 20000 OR rn = 1")
def q_running_budget(spark, d):
    return retrieval.windowed_prefix(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), 20000)


@query("WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS p FROM orders) SELECT o_custkey, arg_min(p, o_orderkey) FILTER (WHERE p IS NOT NULL) AS first_priority FROM r GROUP BY 1")
def q_first_non_null(spark, d):
    value = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))
    rows = table(spark, d, "orders").withColumn("p", value)
    return rows.groupBy("o_custkey").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("o_orderkey"))).alias("first_priority"))


@query(r"""WITH t AS (SELECT page_id, unnest(toks) AS tok, unnest(range(len(toks))) AS k FROM (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?is)<h1[^>]*>.*?</h1>|<a [^>]*>|</?(?:nav|header|footer|main|aside)\b[^>]*>') AS toks FROM pages)),
s AS (SELECT *, last_value(CASE WHEN regexp_matches(tok, '(?i)^</?(nav|header|footer|main|aside)') THEN CASE WHEN tok LIKE '</%' THEN 'body' ELSE lower(regexp_extract(tok, '(?i)^<([a-z]+)', 1)) END END IGNORE NULLS) OVER w AS sec FROM t WINDOW w AS (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, last_value(CASE WHEN regexp_matches(tok, '(?i)^<h1') THEN coalesce(sec, 'body') END IGNORE NULLS) OVER w AS hsec FROM s WINDOW w AS (PARTITION BY page_id ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT page_id, regexp_extract(tok, '(?i)href="([^"]*)"', 1) AS href, coalesce(sec, 'body') AS section, coalesce(hsec = coalesce(sec, 'body'), false) AS headed, count(*) AS n FROM h WHERE regexp_matches(tok, '(?i)^<a ') GROUP BY ALL""")
def q_nearest_heading(spark, d):
    """Links of each page by section, and whether a heading stands before them there."""
    found = dom.headed_links(dom.elements(table(spark, d, "pages"), "page_id", "html"), "page_id")
    return found.groupBy("page_id", "href", "section", F.col("heading").isNotNull().alias("headed")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '<$1>', 'g') AS h FROM pages),
n AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '(?s)^.*<nav>(.*)</nav>.*$', '\1') AS nav, regexp_replace(h, '(?s)<!--.*?-->', '', 'g') AS h FROM b)
SELECT page_id, len(regexp_extract_all(h, '<[A-Za-z$]')) AS elements, len(regexp_extract_all(h, '(?i)<a ')) AS links, len(regexp_extract_all(nav, '(?i)<(ul|li|a)[ >]')) AS in_nav FROM n""")
def q_elements(spark, d):
    """Elements and links of each page, and the elements within its navigation."""
    rows = dom.within(dom.elements(table(spark, d, "pages"), "page_id", "html"), "page_id", F.col("tag") == "nav")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("tag") == "a").alias("links"), F.count_if("inside").alias("in_nav"))


@query(f"WITH {_P}, x AS (SELECT *, {_KIND} AS kind FROM n), y AS (SELECT host, {_TIER} AS tier FROM x) SELECT host, CASE WHEN avg(CASE WHEN coalesce(tier, '') IN ('high', 'medium') THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'high' WHEN avg(CASE WHEN coalesce(tier, '') IN ('high', 'medium') THEN 1.0 ELSE 0.0 END) >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM y GROUP BY 1")
def q_plan_confidence(spark, d):
    from ..functions import rules as R

    rows = table(spark, d, "pages").select(U.host(F.col("url")).alias("host"), F.coalesce(R.tier(F.col("url"), R.page_type(F.col("url"))), F.lit("")).alias("tier"))
    return scoring.confidence(rows, "host", "tier")


@query(f"WITH {_P}, r AS (SELECT host, title, row_number() OVER (PARTITION BY host ORDER BY len(segs), page_id) AS rn FROM n WHERE title <> '') SELECT host, title AS home_title FROM r WHERE rn = 1")
def q_home_titles(spark, d):
    title = T.clean(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1))
    rows = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), F.size(U.segments(F.col("url"))).alias("depth"), title.alias("title")).where("title <> ''")
    return rows.groupBy("host").agg(F.min_by("title", F.struct("depth", "page_id")).alias("home_title"))


@query("SELECT vec_id, label FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 25")
def q_leads_scan(spark, d):
    return table(spark, d, "embeddings").where("label = 1").select("vec_id", "label").orderBy("vec_id").limit(25)


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_leads_count(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P}, {_EDGES}, o AS (SELECT page_id, count(*) FILTER (WHERE href LIKE 'http%') AS outb, count(*) AS n_links FROM e1 GROUP BY 1), z AS (SELECT n.page_id, coalesce(outb, 0) AS outb, coalesce(n_links, 0) AS n_links, regexp_matches(title, '(?i)(^|[^a-z0-9_])(best|top|reviews?|directory)([^a-z0-9_]|$)') AS listicle FROM n LEFT JOIN o ON n.page_id = o.page_id) SELECT page_id, CAST(greatest(0, least(100, CASE WHEN outb >= 15 THEN 25 WHEN outb >= 8 THEN 15 ELSE 0 END + CASE WHEN n_links >= 3 THEN 20 ELSE 0 END + CASE WHEN listicle THEN 15 ELSE 0 END - CASE WHEN outb = 0 AND NOT listicle THEN 20 ELSE 0 END)) AS INTEGER) AS score FROM z")
def q_site_score(spark, d):
    title = T.clean(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1))
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"[^>]*>[^<]*'), F.lit(1))
    out = F.size(F.filter(found, lambda x: x.startswith("http")))
    return table(spark, d, "pages").select("page_id", scoring.site_score(title, out, F.size(found)).alias("score"))


@query("WITH p AS (SELECT c_nationkey, CASE c_custkey % 3 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Sales' END AS dep FROM customer) SELECT c_nationkey, count(*) AS people, count(DISTINCT dep) AS departments, coalesce(bool_or(dep = 'Technology'), false) AS has_technology FROM p GROUP BY 1")
def q_bi_summary(spark, d):
    dep = F.when(F.col("c_custkey") % 3 == 0, "Technology").when(F.col("c_custkey") % 3 == 1, "Sales")
    return scoring.summary(table(spark, d, "customer").withColumn("dep", dep), "c_nationkey", "dep")


@query(SQL["q_emails_scored"].replace('SELECT doc_id, address, score, CAST(row_number()', 'SELECT doc_id, address, score FROM (SELECT doc_id, address, score, CAST(row_number()') + ') WHERE "rank" = 1')
def q_best_email(spark, d):
    ranked = contacts.ranked(contacts.addresses(table(spark, d, "documents"), "doc_id", "text"), "doc_id", F.lit("example.com"))
    return ranked.where("rank = 1").select("doc_id", "address", "score")


@query()
def q_page_structure(spark, d):
    return pages.structure(table(spark, d, "pages"), "page_id", "html").select("page_id", "page.title", "page.h1", "page.lang", "page.n_words", F.size("page.links").alias("n_links"))


_ON = lambda h: f"(dh = '{h}' OR dh LIKE '%.{h}')"


@query(f"WITH {_P}, {_EDGES}, d AS (SELECT page_id, domain, src, dst FROM e UNION ALL SELECT page_id, domain, src, 'https://x.com/' || domain FROM e UNION ALL SELECT page_id, domain, src, 'https://m.facebook.com/p' || page_id % 3 FROM e), dd AS (SELECT *, regexp_extract(dst, '^[a-z]+://([^/?#]*)', 1) AS dh FROM d), pf AS (SELECT *, CASE " + " ".join(f"WHEN {_ON(h)} THEN '{h}'" for h in reversed(scoring.PLATFORMS)) + " END AS platform FROM dd WHERE regexp_matches(dst, '^[a-z]+://[^/]+/[^/]')), c AS (SELECT domain, platform, dst, count(DISTINCT src) AS pages, min(page_id) AS first FROM pf WHERE platform IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY domain, platform ORDER BY pages DESC, first) AS rk FROM c) SELECT domain, platform, dst AS profile, pages FROM r WHERE rk = 1")
def q_social_profiles(spark, d):
    e = links.edges(table(spark, d, "pages")).select("page_id", "domain", "src", "dst")
    x = e.withColumn("dst", F.concat(F.lit("https://x.com/"), "domain"))
    f = e.withColumn("dst", F.concat(F.lit("https://m.facebook.com/p"), (F.col("page_id") % 3).cast("string")))
    return scoring.social_profiles(e.unionByName(x).unionByName(f))
