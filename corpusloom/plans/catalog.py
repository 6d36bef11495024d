"""Registered queries by name, and the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import url as U
from ..operators import contacts, etl, links, organisation, retrieval
from ..session import table
from ..streaming import events as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Pieces of SQL shared by the statements: parts of a URL as macros would give them.
_P = r"""
p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(lower(netloc), '^.*@|:[0-9]+$', ''), '^www\.', '') AS host, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM p),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains(TRACK, lower(string_split(x, '=')[1]))) AS kept FROM u),
n AS (SELECT *, scheme || '://' || netloc || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS stripped,
  scheme || '://' || host || regexp_replace(lower(path), '/+$', '') AS norm, list_transform(segs, lambda x: lower(x)) AS lsegs,
  list_distinct(list_concat(list_transform(segs, lambda x: lower(x)), flatten(list_transform(segs, lambda x: list_filter(string_split(lower(x), '-'), lambda y: y <> ''))))) AS toks,
  trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM k)
""".replace("TRACK", _list(U.TRACKING))
_VISIBLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""
_KIND = "CASE WHEN len(segs) = 0 THEN 'home' " + " ".join(
    (f"WHEN list_has_any(toks, {_list(w.split())}) AND list_has_any(lsegs[1:len(lsegs)-1], {_list(w.split())}) THEN 'blog_post' " if n == "blog" else "") + f"WHEN list_has_any(toks, {_list(w.split())}) THEN '{n}'" for n, w in R.PAGE_TYPES
) + " ELSE 'other' END"
_TIER = f"CASE WHEN list_has_any(toks, {_list(R.IGNORED)}) THEN NULL WHEN list_has_any(toks, {_list(R.HIGH)}) THEN 'high' WHEN list_has_any(toks, {_list(R.MEDIUM)}) THEN 'medium' WHEN list_has_any(toks, {_list(R.LOW)}) THEN 'low' WHEN kind IN ('home', 'about', 'services', 'products') THEN 'high' WHEN kind IN ('blog', 'legal') THEN 'low' ELSE 'unknown' END"
_REG = f"CASE WHEN array_to_string(labels[-2:], '.') IN {_in(U.TWO_LABEL_SUFFIXES)} THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END"
_CONTAINS = lambda col, parts: "(" + " OR ".join(f"contains({col}, '{x}')" for x in parts) + ")"
_UTILITY = f"((contains(host, '.') AND string_split(host, '.')[1] IN {_in(R.UTILITY_LABELS)}) OR {_CONTAINS('lower(path)', R.UTILITY_PATHS)})"
_CLASS = (
    f"CASE WHEN host = '' OR host IN {_in(R.NOISE_HOSTS)} OR " + " OR ".join(f"host LIKE '%.{h}'" for h in R.NOISE_HOSTS) + f" OR string_split({_REG}, '.')[1] IN {_in(R.NOISE_BRANDS)} THEN 'noise' "
    f"WHEN string_split({_REG}, '.')[1] IN {_in([b for some in R.DIRECTORIES.values() for b in some])} THEN 'discovery_source' WHEN {_CONTAINS('lower(path)', R.NOISE_PATHS)} THEN 'noise' "
    f"WHEN {_CONTAINS('lower(path)', R.LISTICLE_PATHS)} OR regexp_matches(TITLE, '{R.LISTICLE_TITLE}') THEN 'discovery_source' ELSE 'official' END"
)
_L = ", l AS (SELECT *, string_split(host, '.') AS labels FROM n)"
_HREF = """(?is)href\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))"""
_EDGES = (
    """e0 AS (SELECT page_id, host AS domain, norm AS src, scheme, path, unnest(found) AS a, unnest(range(0, len(found))) AS pos FROM (SELECT *, regexp_extract_all(html, '(?is)<a\\s[^>]*href\\s*=[^>]*>.*?</a>') AS found FROM n)), """
    f"e1 AS (SELECT *, trim(regexp_extract(a, '{_HREF}', 1) || regexp_extract(a, '{_HREF}', 2) || regexp_extract(a, '{_HREF}', 3)) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS anchor FROM e0), "
    "e2 AS (SELECT *, CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN href LIKE '//%' THEN scheme || ':' || href WHEN href LIKE '/%' THEN scheme || '://' || domain || href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(href, '^(#|$)') THEN NULL "
    "WHEN href LIKE '?%' THEN scheme || '://' || domain || path || href ELSE scheme || '://' || domain || '/' || regexp_extract(path, '^/*(.*/)?[^/]*$', 1) || href END AS full_url FROM e1), "
    "e AS (SELECT page_id, domain, src, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(full_url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(regexp_replace(lower(regexp_extract(full_url, '^[A-Za-z]+://([^/?#]*)', 1)), '^.*@|:[0-9]+$', ''), '^www\\.', '') || regexp_replace(lower(regexp_extract(full_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/+$', '') AS dst, anchor FROM e2 WHERE full_url IS NOT NULL)"
)


@query(
    "WITH t AS (SELECT d.doc_id, d.text, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT count(*) AS n_rows, "
    + ", ".join(f"count(*) FILTER (WHERE trim(coalesce(CAST({c} AS VARCHAR), '')) NOT IN ('', 'N/A')) AS {c}" for c in ("doc_id", "text", "lang", "source", "quality"))
    + " FROM t) "
    + " UNION ALL ".join(f"SELECT n_rows, '{c}' AS column_name, {c} AS filled, round(100.0 * {c} / n_rows, 1) AS fill_pct FROM c" for c in ("doc_id", "text", "lang", "source", "quality"))
)
def q_profile_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return etl.profile(rows, ["doc_id", "text", "lang", "source", "quality"])


@query(f"WITH {_P} SELECT page_id, host FROM n")
def q_host_key(spark, d):
    return table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query(f"WITH {_P}{_L} SELECT page_id, {_REG} AS registered FROM l")
def q_registered_domain(spark, d):
    return table(spark, d, "pages").select("page_id", U.registered_domain(F.col("url")).alias("registered"))


@query(f"WITH {_P} SELECT page_id, stripped FROM n")
def q_strip_tracking(spark, d):
    return table(spark, d, "pages").select("page_id", U.strip_tracking(F.col("url")).alias("stripped"))


@query(f"WITH {_P} SELECT page_id, norm AS normalized FROM n")
def q_normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query(f"WITH {_P}{_L} SELECT page_id, CASE WHEN host = '' THEN 'no_website' WHEN {_CLASS.replace('TITLE', chr(39) * 2)} <> 'official' THEN 'aggregator_domain' WHEN {_UTILITY} THEN 'utility_domain' WHEN length(html) = 0 THEN 'empty_no_contact' ELSE 'kept' END AS reason FROM l")
def q_clean_reasons(spark, d):
    reason = etl.reject_reason(F.col("url"), F.lit(""), F.lit(""), F.length("html"), F.lit(False))
    return table(spark, d, "pages").select("page_id", F.coalesce(reason, F.lit("kept")).alias("reason"))


@query(f"WITH {_P}, r AS (SELECT host AS domain, path, page_id AS ord, length(html) AS content_length, row_number() OVER (PARTITION BY host, path ORDER BY length(html) DESC, page_id) AS rn FROM n) SELECT domain, path, ord, CAST(content_length AS INTEGER) AS content_length FROM r WHERE rn = 1")
def q_dedupe_pages(spark, d):
    rows = etl.crawl_rows(table(spark, d, "pages"))
    return etl.dedupe_pages(rows, ["domain", "path"], F.col("content_length")).select("domain", "path", "ord", "content_length")


@query(
    f"""WITH {_P}, r AS (SELECT host AS domain, stripped, page_id, title, length(regexp_replace(path, '/+$', '')) AS plen, row_number() OVER (PARTITION BY host, stripped ORDER BY length(html) DESC, page_id) AS rn FROM n),
x AS (SELECT * FROM r WHERE rn = 1), t AS (SELECT domain, title, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, min(page_id)) AS rk FROM x WHERE title <> '' GROUP BY domain, title),
g AS (SELECT domain, count(*) AS num_pages, arg_min(stripped, plen * 1000000000 + page_id) AS home_url, string_agg(stripped, ' | ' ORDER BY plen, page_id) AS pages_scraped FROM x GROUP BY domain)
SELECT g.domain, num_pages, home_url, pages_scraped, coalesce(t.title, g.domain) AS company_name FROM g LEFT JOIN t ON g.domain = t.domain AND t.rk = 1"""
)
def q_business_rollup(spark, d):
    rows = etl.crawl_rows(table(spark, d, "pages"))
    return etl.rollup(etl.dedupe_pages(rows, ["domain", "page_url"], F.col("content_length"))).orderBy(F.desc("num_pages"), "domain")


_CONTACT = f"c AS (SELECT source AS domain, coalesce(max(list_max(regexp_extract_all(text, '{contacts.EMAIL}'))), 'N/A') AS email, coalesce(max(list_max(regexp_extract_all(text, '{contacts.PHONE}'))), 'N/A') AS phone, count(*) AS num_pages FROM documents GROUP BY source)"


def _site_contacts(spark, d):
    first = lambda p: F.coalesce(F.max(F.array_max(F.regexp_extract_all("text", F.lit(p), F.lit(1)))), F.lit("N/A"))
    return table(spark, d, "documents").groupBy(F.col("source").alias("domain")).agg(first(contacts.EMAIL).alias("email"), first(contacts.PHONE).alias("phone"), F.count(F.lit(1)).alias("num_pages"))


@query(f"WITH {_CONTACT} SELECT count(*) AS businesses, count(*) FILTER (WHERE email <> 'N/A') AS with_email, round(100.0 * count(*) FILTER (WHERE email <> 'N/A') / greatest(count(*), 1), 1) AS email_pct, count(*) FILTER (WHERE phone <> 'N/A') AS with_phone, round(100.0 * count(*) FILTER (WHERE phone <> 'N/A') / greatest(count(*), 1), 1) AS phone_pct FROM c")
def q_explore_coverage(spark, d):
    return etl.explore(_site_contacts(spark, d), "email", "phone")


@query(f"WITH {_CONTACT} SELECT domain, CASE WHEN email <> 'N/A' AND NOT contains(email, '.com') THEN 'bad_email' ELSE '' END AS _reason, concat_ws(';', CASE WHEN email <> 'N/A' AND NOT contains(email, '.com') THEN 'bad_email' END, CASE WHEN email = 'N/A' AND phone = 'N/A' THEN 'no_contact' END) AS _warnings FROM c")
def q_govern_quarantine(spark, d):
    return etl.govern(_site_contacts(spark, d), "email", "phone", "num_pages", F.contains("email", F.lit(".com"))).select("domain", "_reason", "_warnings")


@query(f"WITH {_P}{_L}, g AS (SELECT DISTINCT host FROM n WHERE contains(host, '.')) SELECT string_split(host, '.')[-1] AS tld, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, min(host) LIMIT 5")
def q_top_tlds(spark, d):
    return etl.top_tlds(table(spark, d, "pages").select(U.host(F.col("url")).alias("domain")).distinct())


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def q_scope_semi(spark, d):
    wanted = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return etl.scope(table(spark, d, "customer"), wanted, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def q_exclude_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q_left_enrich(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("")).alias("nation"), F.coalesce("r_name", F.lit("")).alias("region"))


@query("WITH a AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(value) AS v FROM events WHERE event_type <> 'click' AND value > 50 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(coalesce(a.v, b.v), coalesce(b.v, a.v)) AS value, CASE WHEN a.user_id IS NULL THEN 'other' WHEN b.user_id IS NULL THEN 'click' ELSE 'click,other' END AS origin FROM a FULL JOIN b ON a.user_id = b.user_id")
def q_full_merge_max(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("value")).withColumn("origin", F.lit("click"))
    b = e.where("event_type <> 'click' AND value > 50").groupBy("user_id").agg(F.max("value").alias("value")).withColumn("origin", F.lit("other"))
    return etl.merge_detections(a, b, "user_id", "value", "origin")


@query(f"WITH {_P}, w AS (SELECT * FROM (VALUES ('example.com', 'commercial'), ('example.org', 'society'), ('example.net', 'network')) AS t(suffix, kind)) SELECT page_id, suffix, kind FROM n JOIN w ON host = suffix OR host LIKE '%.' || suffix")
def q_suffix_join(spark, d):
    rules = spark.createDataFrame([("example.com", "commercial"), ("example.org", "society"), ("example.net", "network")], "suffix string, kind string")
    labels = F.split(U.host(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return table(spark, d, "pages").select("page_id", F.explode(suffixes).alias("suffix")).join(F.broadcast(rules), "suffix").select("page_id", "suffix", "kind")


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'no_content' WHEN contains(lower(text), 'idiot') THEN 'excluded' WHEN NOT (contains(lower(text), 'tion') OR contains(lower(text), 'ing')) THEN 'missing_required' ELSE 'passed' END AS verdict, concat_ws(',', CASE WHEN contains(lower(text), 'tion') THEN 'tion' END, CASE WHEN contains(lower(text), 'ing') THEN 'ing' END) AS hits FROM documents")
def q_keyword_qualify(spark, d):
    hits, bad = T.keyword_hits(F.col("text"), ["tion", "ing"]), T.keyword_hits(F.col("text"), ["idiot"])
    verdict = F.when(F.trim("text") == "", "no_content").when(F.size(bad) > 0, "excluded").when(F.size(hits) == 0, "missing_required").otherwise("passed")
    return table(spark, d, "documents").select("doc_id", verdict.alias("verdict"), F.array_join(hits, ",").alias("hits"))


@query(f"""WITH v AS (SELECT page_id, html, {_VISIBLE} AS t FROM pages) SELECT page_id, CASE WHEN html = '' THEN 'empty_response' WHEN regexp_matches(lower(html), 'id=["''](root|app|__next|__nuxt)["'']') AND length(t) < 800 THEN 'spa_shell_marker' WHEN length(t) < 400 THEN 'below_min_chars' WHEN length(t) < 1600 AND length(t) / length(html) < 0.02 THEN 'low_text_ratio' ELSE 'ok' END AS reason, length(t) AS n_visible FROM v""")
def q_sufficiency(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html", T.visible(F.col("html")).alias("v"))
    return rows.select("page_id", R.sufficiency(F.col("html"), F.col("v")).alias("reason"), F.length("v").cast("bigint").alias("n_visible"))


@query(f"WITH {_P}{_L} SELECT page_id, {_CLASS.replace('TITLE', 'title')} AS category FROM l")
def q_classify_result(spark, d):
    title = T.clean(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", R.classify_result(F.col("url"), title).alias("category"))


@query(f"WITH {_P} SELECT page_id, {_KIND} AS page_type FROM n")
def q_page_type(spark, d):
    return table(spark, d, "pages").select("page_id", R.page_type(F.col("url")).alias("page_type"))


@query(f"WITH {_P} SELECT page_id, {_UTILITY} AS is_utility FROM n")
def q_utility_link(spark, d):
    return table(spark, d, "pages").select("page_id", R.is_utility(F.col("url")).alias("is_utility"))


@query("SELECT page_id, " + "CASE WHEN len(segs) = 0 THEN 100 " + " ".join(f"WHEN list_has_any(toks, {_list(w.split())}) THEN {s}" for s, w in R.FALLBACK_SCORES) + " ELSE 40 END AS priority FROM (WITH " + _P + " SELECT * FROM n)")
def q_crawl_priority(spark, d):
    return table(spark, d, "pages").select("page_id", R.fallback_score(F.col("url")).alias("priority"))


@query(f"WITH {_P}, {_EDGES} SELECT * FROM e")
def q_link_edges(spark, d):
    return links.edges(table(spark, d, "pages"))


@query(f"WITH {_P}, {_EDGES} SELECT domain, dst, count(*) AS in_degree, count(DISTINCT src) AS n_sources FROM e GROUP BY 1, 2")
def q_in_degree(spark, d):
    return links.in_degree(links.edges(table(spark, d, "pages")))


@query(f"WITH {_P} SELECT domain, '/' || parent || '/*' AS pattern, count(*) AS n FROM (SELECT host AS domain, array_to_string(segs[1:len(segs)-1], '/') AS parent FROM n WHERE len(segs) >= 2) GROUP BY 1, 2 HAVING count(*) >= 4")
def q_url_patterns(spark, d):
    rows = table(spark, d, "pages").select(U.host(F.col("url")).alias("domain"), "url")
    return links.patterns(rows)


@query(f"WITH {_P}, {_EDGES}, f AS (SELECT dst, lower(anchor) AS low, arg_min(anchor, page_id * 1000000 + pos) AS anchor, min(page_id * 1000000 + pos) AS o FROM e WHERE anchor <> '' AND lower(anchor) NOT IN {_in(links.GENERIC)} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY o) AS rn FROM f) SELECT dst, string_agg(anchor, '|' ORDER BY rn) AS anchors FROM r WHERE rn <= 5 GROUP BY dst")
def q_anchor_capped(spark, d):
    return links.anchors(links.edges(table(spark, d, "pages")))


_CLEAN_LINE = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"


@query(f"WITH l AS (SELECT source, doc_id, {_CLEAN_LINE} AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2")
def q_boilerplate_lines(spark, d):
    return links.boilerplate_lines(table(spark, d, "documents"), "source", "doc_id", "text")


@query(f"WITH l AS (SELECT source, doc_id, x, i, {_CLEAN_LINE} AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)), b AS (SELECT source, line FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2), k AS (SELECT l.source, doc_id, string_agg(x, chr(10) ORDER BY i) AS kept FROM l LEFT JOIN b ON l.source = b.source AND l.line = b.line WHERE b.line IS NULL GROUP BY 1, 2) SELECT d.source, d.doc_id, coalesce(k.kept, '') AS kept FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id")
def q_without_boilerplate(spark, d):
    return links.without_boilerplate(table(spark, d, "documents"), "source", "doc_id", "text")


@query(f"WITH l AS (SELECT doc_id, i, {_CLEAN_LINE} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)), g AS (SELECT doc_id, i, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l WHERE line <> '') SELECT doc_id, count(*) AS n_lines, sha256(string_agg(line, '|' ORDER BY i)) AS lines_sha FROM g WHERE before IS NULL OR before <> line GROUP BY 1")
def q_consecutive_lines(spark, d):
    out = links.consecutive_lines(table(spark, d, "documents"), "doc_id", "text").where(F.size("lines") > 0)
    return out.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.sha2(F.array_join("lines", "|"), 256).alias("lines_sha"))


_LOCAL, _DOMAIN = "string_split(address, '@')[1]", "string_split(address, '@')[-1]"


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i) *[\[(] *at *[\])] *|＠', '@', 'g'), '(?i) *[\[(] *dot *[\])] *', '.', 'g') AS t FROM documents),
a AS (SELECT DISTINCT doc_id, lower(x) AS address FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{contacts.EMAIL}')) AS x FROM t)),
s AS (SELECT doc_id, address, CAST(50 + CASE WHEN {_DOMAIN} = 'example.com' OR {_DOMAIN} LIKE '%.example.com' OR 'example.com' LIKE '%.' || {_DOMAIN} THEN 50 WHEN {_DOMAIN} IN {_in(contacts.FREE)} THEN -30 ELSE -40 END
 + CASE WHEN {_LOCAL} IN {_in(contacts.ROLES)} THEN 30 WHEN regexp_matches({_LOCAL}, '^[a-z]+[._][a-z]+$') THEN 15 ELSE 0 END + CASE WHEN {_LOCAL} IN {_in(contacts.UNREAD)} THEN -80 ELSE 0 END AS INTEGER) AS score FROM a
 WHERE NOT (contains({_LOCAL}, '..') OR {_LOCAL} LIKE '.%' OR {_LOCAL} LIKE '%.' OR contains({_DOMAIN}, '..')) AND {_DOMAIN} NOT IN {_in(contacts.THROWAWAY)} AND regexp_matches({_DOMAIN}, '\.[a-z]{{2,}}$'))
SELECT doc_id, address, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, address) AS INTEGER) AS "rank" FROM s"""
)
def q_emails_scored(spark, d):
    return contacts.ranked(contacts.addresses(table(spark, d, "documents"), "doc_id", "text"), "doc_id", F.lit("example.com"))


@query(rf"WITH p AS (SELECT DISTINCT doc_id, phone FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{contacts.PHONE}')) AS phone FROM documents)) SELECT doc_id, phone, length(regexp_replace(phone, '[^0-9]', '', 'g')) AS digits FROM p WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND NOT regexp_matches(phone, '^[0-9]{{4}}[-.][0-9]{{2}}[-.][0-9]{{2}}')")
def q_phones(spark, d):
    return contacts.phones(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "phone", F.col("digits").cast("bigint").alias("digits"))


@query("SELECT doc_id, left(sha256(text), 16) AS content_key FROM documents")
def q_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_key(F.col("text")).alias("content_key"))


@query(r"SELECT sha256(left(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 2000)) AS signature, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def q_near_exact_dups(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(T.signature(F.col("text")), 256).alias("signature")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))


@query()
def q_chunks(spark, d):
    return retrieval.chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def q_chunk_overlap_stats(spark, d):
    c = retrieval.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.max(F.length("chunk")).alias("longest"))


_QUERY = [round(0.125 if k % 3 else -0.125, 3) for k in range(64)]
_DOT = f"list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QUERY} AS DOUBLE[]))"


@query(f"SELECT vec_id, round({_DOT}, 5) AS similarity FROM embeddings ORDER BY {_DOT} DESC, 1 LIMIT 10")
def q_knn(spark, d):
    return retrieval.nearest(table(spark, d, "embeddings"), _QUERY, 10)


@query(f"SELECT vec_id, round({_DOT}, 5) AS similarity FROM embeddings WHERE label = 1 ORDER BY {_DOT} DESC, 1 LIMIT 10")
def q_knn_filtered(spark, d):
    return retrieval.nearest(table(spark, d, "embeddings"), _QUERY, 10, F.col("label") == 1)


QUESTION = "which texts mention license rights but not public"
_WORDS = retrieval.question_words(QUESTION)
_STRENGTH = "w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM documents), s AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{x}' AS word, CASE WHEN list_contains(ws, '{x}') THEN 1.0 WHEN list_contains(list_transform(ws, lambda y: " + "CASE " + " ".join(f"WHEN y LIKE '%{z}' AND length(y) >= {len(z) + 3} THEN left(y, length(y) - {len(z)})" for z in T.SUFFIXES) + f" ELSE y END), '{retrieval.stem_of(x)}') THEN 0.9 ELSE 0.0 END AS strength FROM w" for x in _WORDS
) + ")"


@query(f"WITH {_STRENGTH} SELECT doc_id, word, CAST(strength AS DOUBLE) AS strength FROM s WHERE strength > 0")
def q_match_strengths(spark, d):
    return retrieval.strengths(table(spark, d, "documents"), "doc_id", "text", _WORDS)


@query(
    f"""WITH {_STRENGTH}, f AS (SELECT word, count(*) FILTER (WHERE strength > 0) AS df FROM s GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT word, df, n, CASE WHEN df = 0 OR n <= 1 THEN 1.0 ELSE ln((n + 1.0) / (df + 1)) / ln((n + 1.0) / 2) END AS idf, CASE WHEN df / n <= 0.35 THEN 1.0 WHEN df / n >= 0.8 THEN 0.0 ELSE 1.0 - (df / n - 0.35) / (0.8 - 0.35) END AS sat FROM f, n)
SELECT word, df, round(idf, 6) AS idf, round(sat, 6) AS saturation, round(round(idf, 6) * round(sat, 6), 6) AS weight FROM i"""
)
def q_idf(spark, d):
    return retrieval.weights_of(table(spark, d, "documents"), "text", _WORDS)


@query(f"WITH {_STRENGTH} SELECT doc_id, round(1.0 - exp(sum(ln(1.0 - 0.5 * strength))), 6) AS combined FROM s WHERE strength > 0 GROUP BY 1")
def q_noisy_or(spark, d):
    found = retrieval.strengths(table(spark, d, "documents"), "doc_id", "text", _WORDS)
    return found.groupBy("doc_id").agg(F.round(retrieval.noisy_or(F.collect_list(F.col("strength") * 0.5)), 6).alias("combined"))


_NEG = rf"""f AS (SELECT doc_id, source, lower(text) AS t, regexp_extract(lower(text), '(?s)^((?:|.*?[^a-z0-9_])the)(?:[^a-z0-9_].*)?$', 1) AS head FROM documents),
g AS (SELECT doc_id, source, head <> '' AS there, regexp_matches(right(left(head, length(head) - 3), 40), '{T.NEGATION.replace("'", "''")}') OR regexp_matches(substring(t, length(head) + 1, 40), '{T.SOFT_NEGATION}') AS neg FROM f)"""


@query(f"WITH {_NEG} SELECT doc_id, CASE WHEN there THEN neg END AS negated FROM g")
def q_negation(spark, d):
    return table(spark, d, "documents").select("doc_id", T.negated(F.col("text"), "the").alias("negated"))


@query(f"WITH {_NEG} SELECT source, CASE WHEN bool_or(there AND NOT neg) AND bool_or(there AND neg) THEN 'MIXED' WHEN bool_or(there AND NOT neg) THEN 'PRESENT' WHEN bool_or(there AND neg) THEN 'ABSENT' ELSE 'NO_EVIDENCE' END AS verdict FROM g GROUP BY 1")
def q_evidence_verdict(spark, d):
    return retrieval.verdicts(table(spark, d, "documents"), "source", "text", "the")


#: Text that each rule knows, one for each page by its number: the pages of the tables have no such marks.
MARKS = (
    "login.salesforce", "js.hs-scripts.com", "zohopublic", "Dynamics 365", "pipedrive", "freshsales", "bitrix24", "Log in", "My Account", "Client Portal", "Dashboard", "Member Area", "js.stripe.com", "paypalobjects",
    "square.site", "authorize.net", "Checkout", "Shopping cart", "Buy now", "widget.intercom", "js.driftt.com", "crisp.chat", "zdassets", "tawk.to", "livechat.com", "gtag(", "G-AB12CD", "googletagmanager.com",
    "mixpanel.com", "hotjar.com", "cdn.segment", "fbq(", "OAuth", "auth0.com", "okta.com", "clerk.dev", "firebaseapp.com", "cart paypal.com", "nothing",
)
_MARKED = "(SELECT page_id, url, html || ' ' || " + _list(MARKS) + f"[CAST(page_id % {len(MARKS)} AS INTEGER) + 1] || ' ' AS html FROM pages)"
_TECH = "t AS (" + " UNION ALL ".join("SELECT page_id, url, '{}' AS category, '{}' AS technology, {} AS confidence, {} AS ord FROM {} AS m WHERE regexp_matches(lower(html), '{}')".format(c, n, k, i, _MARKED, p.replace("'", "''")) for i, (c, n, p, k) in enumerate(organisation.TECH_RULES)) + ")"


@query(f"WITH {_TECH} SELECT page_id, category, technology, confidence FROM t")
def q_tech_rules(spark, d):
    return organisation.detections(_marked(spark, d), "page_id", "html").drop("ord")


def _marked(spark, d):
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.col("page_id") % len(MARKS) + 1).cast("int"))
    return table(spark, d, "pages").withColumn("html", F.concat("html", F.lit(" "), mark, F.lit(" ")))


def _host_caps(spark, d):
    pages = _marked(spark, d).withColumn("host", U.host(F.col("url")))
    return pages, organisation.capabilities(organisation.detections(pages.select("host", "html"), "host", "html"), "host")


@query(f"WITH {_TECH}, {_P}, r AS (SELECT n.host, category, technology, confidence, row_number() OVER (PARTITION BY n.host, category ORDER BY confidence DESC, ord) AS rk FROM t JOIN n ON t.page_id = n.page_id) SELECT host, category, confidence, technology FROM r WHERE rk = 1")
def q_capabilities(spark, d):
    return _host_caps(spark, d)[1].select("host", "category", "confidence", "technology")


@query(f"WITH {_TECH}, {_P}, c AS (SELECT DISTINCT n.host, category FROM t JOIN n ON t.page_id = n.page_id), h AS (SELECT DISTINCT host FROM n), a AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}', {k})" for s, c, k in organisation.ABSENCE) + ") AS v(signal, category, confidence)) SELECT h.host, a.signal, CAST(a.confidence AS DOUBLE) AS confidence FROM h CROSS JOIN a LEFT JOIN c ON c.host = h.host AND c.category = a.category WHERE c.host IS NULL")
def q_signals(spark, d):
    pages, caps = _host_caps(spark, d)
    return organisation.absence_signals(pages.select("host").distinct(), caps, "host")


_ROLES = ["CTO", "Sales Director", "Head of Support", "Owner", "Marketing Manager", "HR Manager", "Clerk", "Operations Manager"]
_ROLE_SQL = f"r AS (SELECT c_custkey, {_list(_ROLES)}[CAST(c_custkey % {len(_ROLES)} AS INTEGER) + 1] AS role FROM customer), dp AS (SELECT c_custkey, role, CASE " + " ".join(f"WHEN regexp_matches(lower(role), '(^|[^a-z0-9_])({w})([^a-z0-9_]|$)') THEN '{n}'" for n, w in organisation.DEPARTMENTS) + " END AS department FROM r)"


def _people(spark, d):
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (F.col("c_custkey") % len(_ROLES) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", role.alias("role")).withColumn("department", organisation.department(F.col("role")))


@query(f"WITH {_ROLE_SQL} SELECT c_custkey, role, department FROM dp")
def q_department(spark, d):
    return _people(spark, d)


@query(f"WITH {_ROLE_SQL} SELECT coalesce(department, 'Unclassified') AS department, count(*) AS n FROM dp GROUP BY 1")
def q_org(spark, d):
    return _people(spark, d).groupBy(F.coalesce("department", F.lit("Unclassified")).alias("department")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ROLE_SQL}, m AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {i})" for i, (a, b, c) in enumerate(organisation.OWNERSHIP)) + ") AS v(department, category, mapped, ord)), j AS (SELECT c_custkey, dp.department, category, round(least(0.78, CAST(mapped AS DOUBLE)), 3) AS likely, ord FROM dp JOIN m ON dp.department = m.department), k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY likely DESC, ord) AS rk FROM j WHERE likely >= 0.5) SELECT c_custkey, department, category, likely, CAST(rk AS INTEGER) AS \"rank\" FROM k WHERE rk <= 5")
def q_ownership(spark, d):
    return organisation.ownership(_people(spark, d).withColumn("confidence", F.lit(0.78)), "c_custkey")


@query(
    f"""WITH {_P}, {_EDGES}, dg AS (SELECT domain, dst, count(*) AS deg FROM e GROUP BY 1, 2), x AS (SELECT *, {_KIND} AS kind, len(string_split({_VISIBLE}, ' ')) AS nw FROM n), y AS (SELECT page_id, host, norm, {_TIER} AS tier, nw, max(nw) OVER (PARTITION BY host) AS longest FROM x),
z AS (SELECT y.page_id, y.host AS domain, y.norm AS page, tier, CAST(CASE tier WHEN 'high' THEN 30 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 ELSE 10 END + least(coalesce(deg, 0), 10) + round_even(8.0 * nw / greatest(longest, 1), 0) AS INTEGER) AS score FROM y LEFT JOIN dg ON dg.domain = y.host AND dg.dst = y.norm WHERE tier IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, page_id) AS priority FROM z) SELECT domain, page_id, tier, score, CAST(priority AS INTEGER) AS priority FROM r WHERE priority <= 8"""
)
def q_route_plan(spark, d):
    pages = table(spark, d, "pages")
    return links.route_plan(pages, links.in_degree(links.edges(pages)))


@query("WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ ]+')) AS n FROM documents) SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(round_even(n / 225, 0) AS INTEGER)) END AS INTEGER) AS minutes FROM w")
def q_reading_time(spark, d):
    n = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", T.reading_minutes(n).alias("minutes"))


@query("SELECT doc_id, CASE WHEN left(x, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || x ELSE x END AS cell FROM (SELECT doc_id, text AS x FROM documents)")
def q_csv_safe(spark, d):
    return table(spark, d, "documents").select("doc_id", T.csv_safe(F.col("text")).alias("cell"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_tumbling(spark, d):
    return ST.tumbling(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def q_session(spark, d):
    return ST.sessions(table(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark, d):
    return ST.dedup(table(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")
