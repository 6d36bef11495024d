"""Registered queries of people, contacts, sources, signals, rounds and focus. Where the tables hold no such rows, the cells are stated from keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import url as U
from ..operators import contacts, crawl, etl, hybrid, links, mail, organisation, people, retrieval, scoring, sites
from ..session import table
from ..streaming import events as ST
from .catalog import _CLASS, _CONTAINS, _EDGES, _L, _P, _TECH, _UTILITY, QUESTION, _host_caps, _in, _marked, query


def _pick(key: str, values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _picked(key: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({key} % {len(values)} AS INTEGER) + 1]"


@query()
def q_hybrid_rank(spark, d):
    pieces = retrieval.chunks(table(spark, d, "documents"), "doc_id", "text")
    return hybrid.rank(pieces, ["doc_id", "chunk_no"], "chunk", QUESTION, 20).select("doc_id", "chunk_no", F.round("score", 6).alias("score"), "evidence", "has_focus")


@query(f"WITH a AS (SELECT DISTINCT doc_id, lower(x) AS address FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{contacts.EMAIL}')) AS x FROM documents)) SELECT doc_id, address, NOT {_CONTAINS('address', contacts.JUNK_PARTS)} AND NOT contains(address, '..') AS valid FROM a")
def q_emails_strict(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return contacts.addresses(docs, "doc_id", "text").select("doc_id", "address", contacts.is_valid_strict(F.col("address")).alias("valid"))


@query("SELECT c_custkey, 'info' || c_custkey || '@shop' || (c_custkey % 7) || '.test' AS plain, 'a' || c_custkey || '@b.test' AS decoded FROM customer")
def q_hidden_addresses(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("info"), F.col("c_custkey").cast("string"), F.lit("&#64;shop"), (F.col("c_custkey") % 7).cast("string"), F.lit("&#x2e;test")).alias("e"), F.base64(F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@b.test")).cast("binary")).alias("b"))
    return rows.select("c_custkey", contacts.decode_entities(F.col("e")).alias("plain"), contacts.decode_base64(F.regexp_replace("b", "=", "")).alias("decoded"))


# The documents' own addresses are under a name that counts as a placeholder, so their pages use another.
_PAGE = "'<html><body><p>' || replace(translate(coalesce(text, ''), '<>&', '   '), 'example.com', 'harbour.org') || '</p></body></html>'"
_SHAPE = "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63})*\\.[A-Za-z]{2,}"
_MAIL_SQL = rf"""WITH p AS (SELECT doc_id, {_PAGE} AS h FROM documents),
f AS (SELECT doc_id, 70 AS base, 'visible_text' AS source, unnest(regexp_extract_all(h, '{_SHAPE}')) AS x FROM p
  UNION ALL SELECT doc_id, 72, 'obfuscated', unnest(regexp_extract_all(h, '(?i)[a-z0-9._%+-]{{1,64}}\s*(?:\[at\]|\(at\)|@| at )\s*[a-z0-9.-]{{1,63}}\s*(?:\[dot\]|\(dot\)|\.| dot )\s*[a-z]{{2,}}')) FROM p
  UNION ALL SELECT doc_id, 72, 'obfuscated', unnest(regexp_extract_all(h, '(?i)[a-z0-9._%+-]{{1,64}}\s*(?:_at_| at )\s*[a-z0-9.-]+\.[a-z]{{2,}}')) FROM p),
a AS (SELECT doc_id, base, source, lower(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\s*(?:\[at\]|\(at\)|_at_| at )\s*', '@', 'g'), '(?i)\s*(?:\[dot\]|\(dot\)| dot )\s*', '.', 'g'), '\s+', '', 'g')) AS address FROM f),
v AS (SELECT doc_id, address, max(base) AS base, arg_max(source, base) AS source, string_split(address, '@')[1] AS loc, string_split(address, '@')[2] AS dom FROM a
  WHERE regexp_matches(string_split(address, '@')[2], '^[^.]+(\.[^.]+)*\.([a-z]{{2}}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|mobi|jobs|travel|tel|cat|asia|post|xxx|app|dev|shop|store|online|site|tech|blog|cloud|agency|studio|company|email|group|world|life|live|news|media|design|digital|global|solutions|services|systems|support|center|club|cafe|restaurant|hotel|boats|yachts|marine)$')
  AND NOT regexp_matches(address, 'example\.|yourdomain|@domain\.com|email@|sentry|wixpress|\.png|\.jpg|\.gif|\.svg|@2x|name@|user@|your@|placeholder') AND string_split(address, '@')[1] <> '' AND NOT regexp_matches(string_split(address, '@')[1], '\.\.|^\.|\.$') GROUP BY doc_id, address),
s AS (SELECT doc_id, address, source, CAST(base + 50 + CASE WHEN dom = 'mail1.harbour.org' THEN 50 WHEN 'mail1.harbour.org' LIKE '%.' || dom THEN 50 WHEN dom IN ('gmail.com', 'yahoo.com', 'outlook.com') THEN -30 ELSE -40 END
  + CASE WHEN loc IN ('info', 'contact', 'hello', 'sales', 'support', 'office', 'mail', 'team') THEN 30 WHEN regexp_matches(loc, '^[a-z]+[._][a-z]+$') THEN 15 ELSE 0 END + CASE WHEN loc IN ('noreply', 'no-reply', 'billing', 'webmaster') THEN -80 ELSE 0 END AS INTEGER) AS score FROM v)
SELECT doc_id, address, source, score FROM s"""


@query(_MAIL_SQL)
def q_email_collectors(spark, d):
    """Addresses of documents shown as pages, by the surest collector, with their scores for one site."""
    text = F.replace(F.translate(F.coalesce("text", F.lit("")), "<>&", "   "), F.lit("example.com"), F.lit("harbour.org"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>")).alias("html"))
    return mail.ranked(mail.collected(rows, "doc_id", "html"), "doc_id", F.lit("mail1.harbour.org")).select("doc_id", "address", "source", "score")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '+4989' || n WHEN c_custkey % 3 = 1 THEN '+089' || n ELSE '' END AS phone FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '7') AS n FROM customer)")
def q_format_phone(spark, d):
    local = F.concat(F.lit("(089) "), F.lpad(F.col("c_custkey").cast("string"), 6, "7"))
    raw = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+"), local)).otherwise(local)
    country = F.when(F.col("c_custkey") % 3 == 0, "de").otherwise("")
    return table(spark, d, "customer").select("c_custkey", contacts.format_phone(raw, country).alias("phone"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || ' Long Harbour Road, Port 10' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') WHEN c_custkey % 3 = 1 THEN c_custkey || ' Mill Lane' ELSE '' END AS address FROM customer")
def q_address(spark, d):
    n = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Visit us: "), n, F.lit(" Long Harbour Road, Port 10"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(" today"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("at\n"), n, F.lit(" Mill Lane"))).otherwise("nowhere")
    return table(spark, d, "customer").select("c_custkey", contacts.address_of(text).alias("address"))


_NAMES, _TITLES = ["Ann Miller", "Bo Stone", "Customer Team", "Cy Young Brown"], ["CTO", "Sales Director", "Head of Support", "a hobby"]


def _cards(spark, d):
    key = F.col("c_custkey").cast("string")
    card = F.when(F.col("c_custkey") % 2 == 0, F.concat(_pick("c_custkey", _NAMES), F.lit(", "), F.lit("CTO"))).otherwise(F.concat(_pick("c_custkey", _NAMES), F.lit("\n"), _pick("c_nationkey", _TITLES)))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("About us\n\n# "), card, F.lit("\nsales@s"), key, F.lit(".test and info@s.test")).alias("text"))


@query(f"SELECT c_custkey, name, role, CASE role WHEN 'CTO' THEN 'Technology' WHEN 'Sales Director' THEN 'Sales' WHEN 'Head of Support' THEN 'Support' END AS department, confidence FROM (SELECT c_custkey, {_picked('c_custkey', _NAMES)} AS name, CASE WHEN c_custkey % 2 = 0 THEN 'CTO' ELSE {_picked('c_nationkey', _TITLES)} END AS role, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.78 END AS DOUBLE) AS confidence FROM customer) WHERE name <> 'Customer Team' AND role <> 'a hobby'")
def q_people(spark, d):
    return people.named(_cards(spark, d), "c_custkey", "text").select("c_custkey", "name", "role", "department", "confidence")


@query("SELECT c_custkey, 'sales@s' || c_custkey || '.test' AS address, 'Sales' AS department FROM customer")
def q_role_mailboxes(spark, d):
    return people.role_mailboxes(_cards(spark, d), "c_custkey", "text").select("c_custkey", "address", "department")


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'https://www.linkedin.com/in/p' || c_custkey END AS profile FROM customer")
def q_profile_links(spark, d):
    c = table(spark, d, "customer")
    url = F.concat(F.when(F.col("c_custkey") % 3 == 0, "https://www.linkedin.com/in/p").otherwise("https://www.linkedin.com/company/p"), F.col("c_custkey").cast("string"))
    found = c.select("c_custkey", F.lit(1).alias("pos"), url.alias("url"), F.upper("c_name").alias("anchor"))
    return people.profile_links(c.select("c_custkey", F.col("c_name").alias("name")), found, "c_custkey").select("c_custkey", "name", "profile")


@query("SELECT o_custkey, 'site' AS origin, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, 'search', count(*) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def q_people_merged(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("name"), "o_orderstatus")
    site = rows.where("o_orderstatus = 'O'").select("o_custkey", "name", F.lit("site").alias("origin"))
    return people.merged(site, site.limit(0), rows.select("o_custkey", "name", F.lit("search").alias("origin")), "o_custkey").groupBy("o_custkey", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("WITH h AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS query, round(0.5 + (o_orderkey % 50) / 100.0, 2) AS confidence FROM orders), s AS (SELECT o_custkey, min(query) AS stop FROM h WHERE confidence >= 0.95 GROUP BY 1), t AS (SELECT h.* FROM h LEFT JOIN s ON h.o_custkey = s.o_custkey WHERE stop IS NULL OR query <= stop), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY confidence DESC, o_orderkey) AS rk FROM t) SELECT o_custkey, o_orderkey, query, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE rk = 1 AND confidence >= 0.72")
def q_best_hit(spark, d):
    hits = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("query"), F.round(F.lit(0.5) + (F.col("o_orderkey") % 50) / 100.0, 2).alias("confidence"))
    return people.best_hit(hits, "o_custkey", "o_orderkey", "confidence")


@query("WITH h AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS query, o_orderkey AS position FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY query, position) AS rk FROM h) SELECT o_custkey, query, position FROM r WHERE rk = 1")
def q_first_query_hit(spark, d):
    hits = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 5).cast("int").alias("query"), F.col("o_orderkey").alias("position"))
    return people.first_query_hit(hits, "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey || ',5K' END AS followers FROM customer")
def q_followers(spark, d):
    snippet = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ships | "), F.col("c_custkey").cast("string"), F.lit(",5K Followers on"))).otherwise("no followers here")
    return table(spark, d, "customer").select("c_custkey", people.followers(snippet).alias("followers"))


_HINTS = _CONTAINS("p", R.CONTACT_HINTS)


@query(f"WITH {_P}, x AS (SELECT page_id, regexp_replace(lower(path), '^/+|/+$', '', 'g') AS p FROM n) SELECT page_id, CAST(CASE WHEN string_split(p, '/')[-1] IN {_in(R.CONTACT_HINTS)} OR p IN {_in(R.CONTACT_HINTS)} THEN 0 WHEN {_HINTS} THEN 1 ELSE 2 END AS INTEGER) AS priority FROM x")
def q_contact_priority(spark, d):
    return table(spark, d, "pages").select("page_id", R.contact_priority(F.col("url")).alias("priority"))


_BRANDS = [*[b for some in R.DIRECTORIES.values() for b in some], "portmaster", "facebook"]
_LEVEL = "CASE " + " ".join(f"WHEN brand IN {_in(v)} THEN '{k}'" for k, v in R.DIRECTORIES.items()) + " END"


def _results(spark, d):
    url = F.concat(F.lit("https://www."), _pick("s_suppkey", _BRANDS), F.lit(".com/x"), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), url.alias("url"))


@query(f"SELECT ord, {_LEVEL} AS confidence FROM (SELECT s_suppkey AS ord, {_picked('s_suppkey', _BRANDS)} AS brand FROM supplier)")
def q_source_confidence(spark, d):
    return _results(spark, d).select("ord", R.source_confidence(F.col("url")).alias("confidence"))


@query(f"WITH b AS (SELECT s_suppkey AS ord, {_picked('s_suppkey', _BRANDS)} AS brand FROM supplier), l AS (SELECT brand, {_LEVEL} AS confidence, min(ord) AS ord FROM b GROUP BY 1, 2) SELECT brand, confidence, ord FROM l WHERE confidence IS NOT NULL ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ord LIMIT 6")
def q_top_sources(spark, d):
    return scoring.top_sources(_results(spark, d), "url").select("brand", "confidence", "ord")


@query("SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS kept FROM documents")
def q_without_consent(spark, d):
    panel = F.lit("Functional Cookies\nWe use Performance Cookies here\n")
    return table(spark, d, "documents").select("doc_id", R.without_consent(F.concat(panel, "text")).alias("kept"))


_STACK = [("modern", "React", "Vercel", "12.1"), ("old", "", "", "4.9"), ("plain", "", "Vercel", "x")]


@query("""WITH p AS (SELECT s_suppkey, s_suppkey % 3 AS k, s_suppkey % 2 = 0 AS crm, s_suppkey % 5 = 0 AS err FROM supplier)
SELECT s_suppkey, 'modern_stack' AS signal, CAST(0.8 AS DOUBLE) AS confidence FROM p WHERE k = 0 AND crm UNION ALL SELECT s_suppkey, 'no_crm', 0.82 FROM p WHERE NOT crm AND NOT err
UNION ALL SELECT s_suppkey, 'no_analytics', 0.75 FROM p WHERE NOT err UNION ALL SELECT s_suppkey, 'no_customer_portal', 0.65 FROM p WHERE NOT err UNION ALL SELECT s_suppkey, 'no_login', 0.6 FROM p WHERE NOT err
UNION ALL SELECT s_suppkey, 'legacy_wordpress', CASE WHEN k = 0 THEN 0.6 ELSE 0.91 END FROM p WHERE NOT (k = 0 AND crm) UNION ALL SELECT s_suppkey, 'outdated_version', 0.7 FROM p WHERE k = 1""")
def q_sales_signals(spark, d):
    k, crm = F.col("s_suppkey") % 3, F.col("s_suppkey") % 2 == 0
    tech = lambda c, n: F.struct(F.lit(c).alias("category"), n.alias("name"))
    found = F.array_compact(F.array(tech("cms", F.lit("WordPress")), F.when(k == 0, tech("frontend", F.lit("React"))), F.when(k != 1, tech("hosting", F.lit("Vercel"))), F.when(crm, tech("crm", F.lit("HubSpot")))))
    profiles = table(spark, d, "supplier").select("s_suppkey", found.alias("technologies"), F.array_compact(F.array(F.when(crm, F.lit("crm")))).alias("capabilities"), F.array(F.when(k == 0, "12.1").when(k == 1, "4.9").otherwise("x")).alias("versions"), (F.col("s_suppkey") % 5 == 0).alias("error"))
    return organisation.sales_signals(profiles, "s_suppkey").select("s_suppkey", "signal", "confidence")


@query("SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS sid, CAST(2 AS INTEGER) AS n FROM supplier")
def q_cookies(spark, d):
    key = F.col("s_suppkey").cast("string")
    jar = organisation.cookies(F.array(F.lit("sid=old; Path=/"), F.lit("not a cookie"), F.concat(F.lit("sid="), key, F.lit("; Secure")), F.lit('theme="dark"')))
    return table(spark, d, "supplier").select("s_suppkey", jar.alias("jar")).select("s_suppkey", F.element_at("jar", "sid").alias("sid"), F.size("jar").alias("n"))


@query(f"WITH {_P}{_L} SELECT page_id, CASE WHEN host = '' THEN 'no_website' WHEN {_CLASS.replace('TITLE', chr(39) * 2)} <> 'official' THEN 'aggregator_domain' WHEN {_UTILITY} THEN 'utility_domain' WHEN page_id % 7 = 0 THEN 'failed_relevance:reject' WHEN page_id % 5 = 1 THEN 'validated_for_different_industry' WHEN page_id % 5 = 2 THEN 'validated_for_different_location' WHEN page_id % 5 = 3 THEN 'empty_no_contact' ELSE 'kept' END AS reason FROM l")
def q_clean_scope(spark, d):
    k = F.col("page_id") % 5
    reason = etl.reject_reason(F.col("url"), F.lit(""), F.when(F.col("page_id") % 7 == 0, " Reject").otherwise("MATCH"), F.when(k == 3, 0).otherwise(9), F.lit(False), (F.when(k == 1, "bakeries").when(k == 0, " Marinas "), "marinas"), (F.when(k == 2, "Oslo").when(k == 0, "bergen"), "Bergen"))
    return table(spark, d, "pages").select("page_id", F.coalesce(reason, F.lit("kept")).alias("reason"))


@query(f"WITH {_P}, {_EDGES}, s AS (SELECT host, count(*) AS many FROM n GROUP BY 1), known AS (SELECT e.domain, count(*) AS links, count(*) FILTER (WHERE m.norm IS NULL) AS fresh FROM e LEFT JOIN (SELECT DISTINCT host, norm FROM n) m ON m.host = e.domain AND m.norm = e.dst GROUP BY 1) SELECT s.host AS domain, many < 3 AND (links IS NULL OR fresh > 0) AS recrawl FROM s LEFT JOIN known ON s.host = known.domain")
def q_needs_recrawl(spark, d):
    pages = table(spark, d, "pages")
    stored = pages.select(U.host(F.col("url")).alias("domain"), U.normalize(F.col("url")).alias("page"))
    return scoring.needs_recrawl(stored, links.edges(pages), "domain", "page", "dst")


@query("SELECT o_custkey, bool_and(o_totalprice > 20000) AS passed FROM orders GROUP BY 1")
def q_all_pass(spark, d):
    return scoring.all_pass(table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") > 20000).alias("ok")), "o_custkey", "ok")


def _variants(spark, d):
    host = U.host(F.col("url"))
    html = F.concat(F.lit('<head><link rel="alternate" hreflang="x-default" href="/"><link rel="alternate" hreflang="EN-gb" href="/en/"><link hreflang="it" rel="alternate" href="https://'), host, F.lit('/it/home"></head>'))
    return table(spark, d, "pages").select("page_id", "url", host.alias("host"), html.alias("html"))


@query(f"WITH {_P}, h AS (SELECT page_id, host, scheme || '://' || netloc AS base FROM n) SELECT page_id, 'en-gb' AS code, base || '/en/' AS href FROM h UNION ALL SELECT page_id, 'it', 'https://' || host || '/it/home' FROM h")
def q_language_alternates(spark, d):
    return links.language_alternates(_variants(spark, d), "page_id", "url", "html")


@query(f"WITH {_P}{_L} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/' ELSE '/de' END AS path FROM l WHERE page_id % 3 <> 1")
def q_without_other_languages(spark, d):
    pages = _variants(spark, d)
    tell = links.language_alternates(pages, "page_id", "url", "html").join(pages.select("page_id", U.registered_domain(F.col("url")).alias("site")), "page_id")
    rows = pages.select("page_id", U.registered_domain(F.col("url")).alias("site"), F.concat(F.lit("https://"), "host", F.when(F.col("page_id") % 3 == 0, "/").when(F.col("page_id") % 3 == 1, "/it/x").otherwise("/de")).alias("u"))
    return links.without_other_languages(rows, "u", tell, "site").select("page_id", U.path(F.col("u")).alias("path"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'context of ' || doc_id ELSE CASE WHEN length(t) > 600 THEN rtrim(left(t, 599)) || '…' ELSE t END END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def q_previews(spark, d):
    docs = table(spark, d, "documents")
    told = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("context of "), F.col("doc_id").cast("string")).alias("context"))
    return links.previews(docs, told, docs.select("doc_id", "text"), "doc_id")


_ENDS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'failed' ELSE 'started' END"


def _steps(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "failed").otherwise("started")
    return table(spark, d, "events").select("event_id", "user_id", "ts", kind.alias("kind"))


@query(f"WITH e AS (SELECT user_id, ts, {_ENDS} AS kind FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, kind) AS rk FROM e WHERE kind <> 'started') SELECT user_id, kind FROM r WHERE rk = 1")
def q_terminal(spark, d):
    return ST.terminal(_steps(spark, d), "user_id", "ts").select("user_id", "kind")


@query(f"WITH e AS (SELECT user_id, {_ENDS} AS kind FROM events) SELECT user_id, count(*) FILTER (WHERE kind = 'started') AS started, count(*) FILTER (WHERE kind <> 'started') AS ended FROM e GROUP BY 1")
def q_complete(spark, d):
    return ST.complete(_steps(spark, d), "user_id")


@query(f"WITH {_P} SELECT page_id, CAST(floor((row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) / 3) AS INTEGER) AS wave FROM n")
def q_waves(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return ST.waves(rows, "host", "page_id").select("page_id", "wave")


@query("SELECT c_custkey, CAST(c_custkey % 3 + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS INTEGER) AS fail_count, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN c_custkey % 3 + 1 <= 2 WHEN 2 THEN false ELSE true END AS open FROM customer")
def q_revisit(spark, d):
    c = table(spark, d, "customer")
    state = c.select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("fail_count"), F.lit(True).alias("open"))
    told = c.where("c_custkey % 4 < 3").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "ok").when(F.col("c_custkey") % 4 == 1, "soft").otherwise("rejected").alias("outcome"))
    return ST.revisit(state, told, "c_custkey")


_PRIORITY = lambda p: f"CAST(CASE WHEN string_split({p}, '/')[-1] IN {_in(R.CONTACT_HINTS)} OR {p} IN {_in(R.CONTACT_HINTS)} THEN 0 WHEN {_CONTAINS(p, R.CONTACT_HINTS)} THEN 1 ELSE 2 END AS INTEGER)"


@query(f"""WITH RECURSIVE {_P}, {_EDGES}, kn AS (SELECT host AS site, norm AS url, min(page_id) AS id FROM n GROUP BY 1, 2),
near AS (SELECT a.site, a.url AS src, b.url AS dst, 1000 + b.k - a.k AS pos FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY id) AS k FROM kn) a JOIN (SELECT *, row_number() OVER (PARTITION BY site ORDER BY id) AS k FROM kn) b ON a.site = b.site AND b.k BETWEEN a.k + 1 AND a.k + 2),
l AS (SELECT site, src, dst, pos, {_PRIORITY("regexp_replace(lower(regexp_extract(dst, '^[a-z]+://[^/]*(.*)$', 1)), '^/+|/+$', '', 'g')")} AS priority FROM (SELECT domain AS site, src, dst, pos FROM e WHERE dst <> '://' UNION ALL SELECT site, src, dst, pos FROM near)),
adj AS (SELECT site, src, list(dst ORDER BY priority, pos, dst) AS links FROM l GROUP BY 1, 2),
r AS (SELECT site, 0 AS step, list_transform(links, lambda x: struct_pack(u := x, d := 1)) AS q, [struct_pack(u := url, d := 0, kept := true)] AS seen, [url] AS urls FROM (SELECT site, arg_min(url, url) AS url FROM kn GROUP BY 1) s LEFT JOIN adj USING (site) WHERE adj.src = url OR adj.src IS NULL
  UNION ALL SELECT r.site, step + 1, list_concat(q[2:], CASE WHEN kn.url IS NULL OR list_contains(urls, q[1].u) OR q[1].d >= 50 THEN [] ELSE list_transform(list_filter(coalesce(links, []), lambda x: NOT list_contains(urls, x)), lambda x: struct_pack(u := x, d := q[1].d + 1)) END),
    CASE WHEN list_contains(urls, q[1].u) THEN seen ELSE list_append(seen, struct_pack(u := q[1].u, d := q[1].d, kept := kn.url IS NOT NULL)) END, CASE WHEN list_contains(urls, q[1].u) THEN urls ELSE list_append(urls, q[1].u) END
  FROM r LEFT JOIN kn ON kn.site = r.site AND kn.url = q[1].u LEFT JOIN adj ON adj.site = r.site AND adj.src = q[1].u WHERE len(q) > 0 AND len(urls) <= 150 AND len(list_filter(seen, lambda x: x.kept)) < 40)
SELECT site, v.u AS url, v.d AS depth, CAST(place - 1 AS INTEGER) AS place, v.kept AS kept FROM (SELECT site, unnest(seen) AS v, unnest(range(1, len(seen) + 1)) AS place FROM (SELECT site, arg_max(seen, step) AS seen FROM r GROUP BY 1))""")
def q_crawl(spark, d):
    """Visits of each site from its first address, by the links of its pages and by links from each page to the site's next two."""
    pages = table(spark, d, "pages")
    known = pages.groupBy(U.host(F.col("url")).alias("site"), U.normalize(F.col("url")).alias("url")).agg(F.min("page_id").alias("id"))
    in_order = Window.partitionBy("site").orderBy("id")
    after = known.withColumns({"a": F.lead("url", 1).over(in_order), "b": F.lead("url", 2).over(in_order)})
    near = after.select("site", F.col("url").alias("src"), F.posexplode(F.array_compact(F.array("a", "b"))).alias("k", "dst")).select("site", "src", "dst", (F.col("k") + 1001).alias("pos"))
    found = links.edges(pages).select(F.col("domain").alias("site"), "src", "dst", "pos").unionByName(near)
    return crawl.crawl(known.select("site", "url"), found.withColumn("priority", R.contact_priority(F.col("dst"))), known.select("site", "url", F.lit(True).alias("has")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a' || c_custkey || '@x.test' WHEN 3 THEN 'b@y.test | c@z.test' ELSE 'N/A' END AS emails FROM customer")
def q_clean_multi(spark, d):
    key = F.col("c_custkey").cast("string")
    cell = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("A"), key, F.lit("@x.test | bad | a"), key, F.lit("@X.test"))).when(F.col("c_custkey") % 4 == 1, "N/A").when(F.col("c_custkey") % 4 == 2, "").otherwise("b@y.test|c@z.test")
    return table(spark, d, "customer").select("c_custkey", sites.clean_multi(cell, contacts.is_valid_strict, lower=True).alias("emails"))


def _cells(spark, d):
    mail = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), F.col("o_orderkey") % 4, F.lit("@other.test | me@gmail.com"))).when(F.col("o_custkey") % 2 == 0, "y@far.test").otherwise("N/A")
    return table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 50, F.lit(".test")).alias("site"), "o_orderkey", mail.alias("email"), F.concat(F.lit("+"), F.col("o_orderkey") % 11).alias("phone"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.col("o_orderkey"), F.lit(" Mill Lane"))).otherwise("N/A").alias("address"))


@query("""WITH r AS (SELECT 's' || (o_custkey % 50) || '.test' AS site, o_orderkey, o_custkey FROM orders),
m AS (SELECT site, o_orderkey, 0 AS p, 'x' || (o_orderkey % 4) || '@other.test' AS v, false AS near FROM r WHERE o_orderkey % 3 = 0 UNION ALL SELECT site, o_orderkey, 1, 'me@gmail.com', true FROM r WHERE o_orderkey % 3 = 0 UNION ALL SELECT site, o_orderkey, 0, 'y@far.test', false FROM r WHERE o_orderkey % 3 <> 0 AND o_custkey % 2 = 0),
f AS (SELECT site, v, near, min(o_orderkey * 10 + p) AS o FROM m GROUP BY 1, 2, 3), g AS (SELECT *, bool_or(near) OVER (PARTITION BY site) AS anynear FROM f), e AS (SELECT site, string_agg(v, ' | ' ORDER BY o) AS emails FROM g WHERE near OR NOT anynear GROUP BY 1),
p AS (SELECT site, '+' || (o_orderkey % 11) AS v, min(o_orderkey) AS o FROM r GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY o) AS rk FROM p), h AS (SELECT site, string_agg(v, ' | ' ORDER BY o) AS phones FROM q WHERE rk <= 8 GROUP BY 1),
a AS (SELECT site, min(o_orderkey) AS o FROM r WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT s.site, coalesce(emails, 'N/A') AS emails, coalesce(phones, 'N/A') AS phones, coalesce(a.o || ' Mill Lane', 'N/A') AS address FROM (SELECT DISTINCT site FROM r) s LEFT JOIN e ON e.site = s.site LEFT JOIN h ON h.site = s.site LEFT JOIN a ON a.site = s.site""")
def q_site_contacts(spark, d):
    return sites.site_contacts(_cells(spark, d), "site", "o_orderkey", "email", "phone", "address")


@query("WITH h AS (SELECT DISTINCT source, k FROM documents, (VALUES ('tion'), ('ing'), ('zzqq')) AS v(k) WHERE contains(lower(text), k)) SELECT s.source, coalesce(string_agg(k, ',' ORDER BY k), '') AS keywords FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN h ON h.source = s.source GROUP BY 1")
def q_site_keywords(spark, d):
    from ..functions import text as T

    return sites.keyword_union(table(spark, d, "documents").select("source", T.keyword_hits(F.col("text"), ["tion", "ing", "zzqq"]).alias("hits")), "source", "hits")


_DEPS = ["Sales", "Technology", "Wizardry", "Executive"]


def _staff(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_nationkey", F.when(k % 5 > 0, F.col("c_name")).alias("name"), _pick("c_custkey", _DEPS).alias("department"), F.when(k % 2 == 0, "website").otherwise("search").alias("source"), F.when(k % 7 == 0, "p").alias("profile"))


@query(f"SELECT c_nationkey, CASE WHEN x = 'Wizardry' THEN 'Unclassified' ELSE x END AS department, count(*) AS n FROM (SELECT c_nationkey, {_picked('c_custkey', _DEPS)} AS x FROM customer) GROUP BY 1, 2")
def q_organisation(spark, d):
    return sites.organisation(_staff(spark, d), "c_nationkey")


@query(f"SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 5 > 0) AS named, string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'website' ELSE 'search' END, ',' ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 'website' ELSE 'search' END) AS sources, count(DISTINCT {_picked('c_custkey', _DEPS)}) AS departments, bool_or(c_custkey % 4 = 3) AS has_executive, bool_or(c_custkey % 4 = 1) AS has_technology, bool_or(c_custkey % 7 = 0) AS has_profile FROM customer GROUP BY 1")
def q_people_summary(spark, d):
    return sites.summary(_staff(spark, d), "c_nationkey")


@query(f"WITH {_P}, {_TECH}, r AS (SELECT n.host, category, technology, confidence, row_number() OVER (PARTITION BY n.host, category ORDER BY confidence DESC, ord) AS rk FROM t JOIN n ON t.page_id = n.page_id), h AS (SELECT DISTINCT host FROM n) SELECT h.host, c.category, CASE WHEN technology IS NULL THEN 'not_publicly_detected' ELSE 'detected' END AS status, technology, confidence FROM h CROSS JOIN (VALUES ('crm'), ('chat'), ('payments')) AS c(category) LEFT JOIN r ON r.host = h.host AND r.category = c.category AND rk = 1")
def q_capability_grid(spark, d):
    pages, caps = _host_caps(spark, d)
    return sites.grid(pages.select("host").distinct(), caps, "host", ["crm", "chat", "payments"])


@query(f"WITH {_P}, {_TECH} SELECT n.host, category, string_agg(DISTINCT technology, ',' ORDER BY technology) AS technologies FROM t JOIN n ON t.page_id = n.page_id GROUP BY 1, 2")
def q_categories_view(spark, d):
    pages = _marked(spark, d).withColumn("host", U.host(F.col("url")))
    return sites.categories_view(organisation.detections(pages.select("host", "html"), "host", "html"), "host")


_LINKS = ["https://x.com/@port", "https://www.linkedin.com/company/port-co/", "https://facebook.com/sharer/x", "https://x.com/port/status/1", "https://youtube.com/"]


@query("SELECT s_suppkey, [true, true, false, false, false][CAST(s_suppkey % 5 AS INTEGER) + 1] AS profile, ['port', 'port-co', 'sharer', 'port', NULL][CAST(s_suppkey % 5 AS INTEGER) + 1] AS handle FROM supplier")
def q_handles(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", _pick("s_suppkey", _LINKS).alias("u"))
    return rows.select("s_suppkey", sites.is_profile(F.col("u")).alias("profile"), sites.handle(F.col("u")).alias("handle"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus = 'F' AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS rk FROM orders) SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS \"rank\" FROM r WHERE (w AND rk <= 8) OR rk <= 3")
def q_chosen(spark, d):
    return sites.chosen(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey", F.col("o_orderstatus") == "F", 8, 3).select("o_custkey", "o_orderkey", "rank")


@query("WITH r AS (SELECT page_id, length(html) + CASE WHEN page_id % 2 = 0 THEN 5000 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 2000 ELSE 0 END AS n FROM pages) SELECT page_id, CAST(n AS INTEGER) AS richness FROM r")
def q_richness(spark, d):
    mail, phone = F.when(F.col("page_id") % 2 == 0, "a@b.c").otherwise("N/A"), F.when(F.col("page_id") % 3 == 0, "+1").otherwise("")
    return table(spark, d, "pages").select("page_id", sites.richness(F.length("html"), mail, phone).alias("richness"))


@query(f"SELECT page_id, priority FROM (SELECT page_id, host, priority, row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id) AS rk FROM (SELECT page_id, host, CASE WHEN len(segs) = 0 THEN 100 " + " ".join("WHEN list_has_any(toks, [" + ", ".join(f"'{x}'" for x in w.split()) + f"]) THEN {s}" for s, w in R.FALLBACK_SCORES) + f" ELSE 40 END AS priority FROM (WITH {_P} SELECT * FROM n)) WHERE priority >= 30) WHERE rk <= 3")
def q_crawl_selection(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), R.fallback_score(F.col("url")).alias("priority")).where("priority >= 30")
    return sites.chosen(rows, "host", "priority", "page_id", F.lit(True), 3, 0).select("page_id", "priority")


@query(f"WITH {_P} SELECT page_id, host, stripped FROM n WHERE host = (SELECT min(host) FROM n)")
def q_indexed_urls(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.strip_tracking(F.col("url")).alias("stripped"))
    return rows.join(F.broadcast(rows.agg(F.min("host").alias("host"))), "host", "left_semi").select("page_id", "host", "stripped")
