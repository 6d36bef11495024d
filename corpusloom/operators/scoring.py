"""URL and site scores, junk tests, names and slugs, social profiles, the discovery queue, and summaries."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import rules as R
from ..functions import text as T
from ..functions import url as U

# Weights of path tokens by how much a page invites to buy or sign up, and tokens that lower a page.
INTENT = {"menu": 105, "booking": 100, "book": 90, "appointment": 100, "reserve": 95, "reservation": 95, "schedule": 90, "order": 70, "checkout": 85, "pricing": 90, "price": 80, "plans": 80, "packages": 70, "rates": 70, "services": 75, "service": 70, "products": 70, "product": 65, "membership": 80, "subscribe": 60, "portal": 90, "client-portal": 100, "dashboard": 85, "platform": 80, "software": 80, "solutions": 75, "app": 85, "apps": 85, "quote": 75, "signup": 70, "register": 65, "get-started": 70, "demo": 70, "contact": 50}
LOW_INTENT = "about history team gallery events faq testimonials reviews story mission values partners awards".split()
# Schemes, extensions, path tokens and hosts of links that are not worth a visit.
JUNK_SCHEMES = ("mailto", "javascript", "tel", "sms", "data", "ftp", "file", "callto", "skype", "whatsapp", "viber")
JUNK_ENDS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".bmp", ".tiff", ".avif", ".mp4", ".webm", ".avi", ".mov", ".wmv", ".mkv", ".mp3", ".wav", ".ogg", ".flac",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".zip", ".rar", ".gz", ".tar", ".7z", ".dmg", ".exe", ".pkg",
    ".css", ".js", ".mjs", ".json", ".xml", ".rss", ".atom", ".ics", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".map",
)
JUNK_TOKENS = (
    "privacy", "privacy-policy", "terms", "tos", "terms-of-service", "terms-and-conditions", "cookie", "cookies", "cookie-policy", "legal", "gdpr", "disclaimer", "impressum", "accessibility",
    "careers", "career", "jobs", "job", "vacancies", "hiring", "blog", "news", "press", "media", "press-release", "newsroom", "rss", "feed", "feeds", "atom", "sitemap", "robots", "favicon",
    "logout", "signout", "sign-out", "unsubscribe", "cart", "checkout-success", "wishlist", "compare", "share", "download", "downloads", "print", "search", "tag", "tags", "category", "categories",
    "archive", "archives", "author", "wp-admin", "wp-login", "wp-json", "xmlrpc", "cdn-cgi", "assets", "static", "fonts", "media-library",
)
JUNK_HOSTS = (
    "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "youtu.be", "tiktok.com", "pinterest.com", "reddit.com", "snapchat.com", "threads.net",
    "wa.me", "whatsapp.com", "t.me", "telegram.me", "telegram.org", "google.com", "goo.gl", "maps.google.com", "g.page", "apps.apple.com", "itunes.apple.com", "play.google.com",
    "gravatar.com", "cloudflare.com", "gstatic.com", "googleapis.com", "doubleclick.net", "googletagmanager.com",
)


@dataclass(frozen=True)
class JunkFilter:
    """What makes a link junk, as data: dataclasses.replace makes another filter of it."""

    schemes: tuple = JUNK_SCHEMES
    ends: tuple = JUNK_ENDS
    tokens: tuple = JUNK_TOKENS
    hosts: tuple = JUNK_HOSTS


# Hosts and paths that a crawl leaves out, profile hosts, function words by language.
NOISE_LABELS = "cdn static assets img images media".split()
NOISE_PARTS = "/wp-admin /wp-login /wp-json /cdn-cgi /cart /wishlist /privacy /terms /cookies /cookie-policy /sitemap /robots.txt /feed /rss /tag/ /author/ /search /logout /log-out /forgot-password /reset-password /blog /blogs /news /article /articles /press /category /categories /page/ /booking /book- /schedule /appointments".split()
PLATFORMS = ("facebook.com", "instagram.com", "linkedin.com", "youtube.com", "twitter.com", "x.com", "tiktok.com", "pinterest.com")
ENGLISH = "the and of to is for in on with are this your our we you from as at by".split()
OTHERS = {
    "it": "il la di che per un una sono questo nel della con non sei gli".split(), "fr": "le la de et pour un une les des est dans que vous nous".split(), "de": "der die das und ist für mit nicht ein eine sie auf wir".split(),
    "es": "el la de que para un una los las es en con no nosotros".split(), "pt": "o a de que para um uma os as em com não nós".split(),
}


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def score_url(url: Column) -> Column:
    """Weights of the path's tokens (hyphened ones anywhere in the path), -40 for low intent, minus the depth."""
    tokens, path = U.path_tokens(url), F.lower(U.path(url))
    hits = [F.when(F.array_contains(tokens, k) | (F.contains(path, F.lit(k)) if "-" in k else F.lit(False)), w).otherwise(0) for k, w in INTENT.items()]
    return _sum(hits) - F.when(R.overlaps(tokens, LOW_INTENT), 40).otherwise(0) - U.depth(url)


def is_junk(url: Column, site: Column, rules: JunkFilter = JunkFilter()) -> Column:
    """Another scheme, a host of the list, another site, a file, or a token of pages that say nothing."""
    path, host = F.lower(U.path(url)), U.host(url)
    out = ~U.scheme(url).isin("http", "https") | U.scheme(url).isin(*rules.schemes) | (U.registered_domain(url) != site) | R.overlaps(U.path_tokens(url), rules.tokens)
    for e in rules.ends:
        out = out | path.endswith(e)
    for h in rules.hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def is_crawl_noise(url: Column) -> Column:
    """Asset hosts, noisy path parts, article-like slugs of five hyphens or more, date archives."""
    path = F.lower(U.path(url))
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    part = F.lit(False)
    for p in NOISE_PARTS:
        part = part | F.contains(path, F.lit(p))
    return F.split(U.host(url), r"\.")[0].isin(*NOISE_LABELS) | part | (F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit(""))) >= 5) | path.rlike(r"^/(19|20)[0-9]{2}(/|$)")


def is_non_english(lang: Column, text: Column) -> Column:
    """By the declared language's code, else by function words: 20 tokens or more, and of one other language five or more, half as many again as
    English ones. Each language is tested by itself; letters with accents belong to tokens."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zà-ÿ]+)"), F.lit(1))
    count = lambda t, words: F.size(F.filter(t, lambda w: w.isin(*words)))
    code = F.trim(F.split_part(F.coalesce(lang, F.lit("")), F.lit("-"), F.lit(1)))

    def foreign(t):
        english, out = count(t, ENGLISH), F.lit(False)
        for words in OTHERS.values():
            out = out | ((count(t, words) >= 5) & (count(t, words) > 1.5 * english))
        return (F.size(t) >= 20) & out

    return F.when(code != "", code != "en").otherwise(F.transform(F.array(tokens), foreign)[0])


def site_score(title: Column, outbound: Column, patterns: Column) -> Column:
    """0 to 100: how much a home page looks like a directory of businesses."""
    listicle = F.coalesce(title, F.lit("")).rlike(R.LISTICLE_TITLE)
    raw = F.when(outbound >= 15, 25).when(outbound >= 8, 15).otherwise(0) + F.when(patterns >= 3, 20).otherwise(0) + F.when(listicle, 15).otherwise(0) - F.when((outbound == 0) & ~listicle, 20).otherwise(0)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(100))


def page_name(url: Column) -> Column:
    """A file name from the last path segment: other characters become one hyphen; "home" without a path."""
    last = F.element_at(F.split(F.regexp_replace(U.path(url), "/+$", ""), "/"), -1)
    name = F.regexp_replace(F.lower(F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "-")), "^-+|-+$", "")
    return F.left(F.when(F.coalesce(name, F.lit("")) == "", "home").otherwise(name), F.lit(120))


def _probe(rows: pd.DataFrame) -> pd.DataFrame:
    """Names of a family in order: the name itself if it is free, else the first free of name-2, name-3, ..."""
    taken, out = set(), []
    for name in rows.sort_values("__o")["__name"]:
        k, got = 1, name
        while got in taken:
            k += 1
            got = f"{name}-{k}"
        taken.add(got)
        out.append(got)
    return rows.sort_values("__o").assign(unique_name=out)


def unique_names(pages: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Second and later pages of a name get -2, -3, ... in order; a name that another page has by then is skipped. Only names of a
    family (equal but for trailing numbers) can collide. Families with repeats and with numbered names are probed in order, one family
    in a task; the others are numbered by a window."""
    keyed = pages.select("*", F.col(name).alias("__name"), F.col(order).alias("__o"), F.regexp_replace(name, r"(-[0-9]+)+$", "").alias("__root"))
    families = keyed.groupBy(group, "__root", "__name").count().groupBy(group, "__root").agg((F.max("count") > 1).alias("repeats"), (F.count(F.lit(1)) > 1).alias("several"))
    marked = keyed.join(families.where("repeats AND several").select(group, "__root", F.lit(True).alias("__mixed")), [group, "__root"], "left")
    k = F.row_number().over(Window.partitionBy(group, "__name").orderBy("__o"))
    plain = marked.where("__mixed IS NULL").drop("__mixed").withColumn("unique_name", F.when(k == 1, F.col("__name")).otherwise(F.concat("__name", F.lit("-"), k.cast("string"))))
    mixed = marked.where("__mixed").drop("__mixed")
    probed = mixed.groupBy(group, "__root").applyInPandas(_probe, _with_text(mixed, "unique_name"))
    return plain.unionByName(probed).drop("__name", "__o", "__root")


def _with_text(df: DataFrame, column: str):
    return types.StructType([*df.schema.fields, types.StructField(column, types.StringType())])


def slugs(name: Column) -> Column:
    """Candidate slugs of a name: words joined by hyphens, run together, and the first word."""
    words = T.words(name)
    return F.array_distinct(F.filter(F.array(F.array_join(words, "-"), F.array_join(words, ""), F.coalesce(F.get(words, 0), F.lit(""))), lambda s: s != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' words; 0 without words."""
    x, y = F.array_distinct(T.words(a)), F.array_distinct(T.words(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


def title_confidence(a: Column, b: Column) -> Column:
    """The lesser of the matching-blocks ratio (a pandas function: there is no such built-in) and the words' similarity."""
    return F.least(F.pandas_udf(_ratios, "double")(a, b), token_similarity(a, b))


def _repair(texts: pd.Series) -> pd.Series:
    def one(s):
        try:
            fixed = s.encode("cp1252").decode("utf-8")
        except (UnicodeError, AttributeError):
            return s
        return fixed if len(re.findall("[ÃÂâ]", fixed)) < len(re.findall("[ÃÂâ]", s)) else s

    return texts.map(one)


def fix_mojibake(s: Column) -> Column:
    """Texts read as cp1252 that were UTF-8, repaired. Python sees only texts with a suspicious character."""
    return F.when(s.rlike("[ÃÂâ]"), F.pandas_udf(_repair, "string")(F.when(s.rlike("[ÃÂâ]"), s))).otherwise(s)


def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b or "", (h or "").strip())
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


def resolve(base: Column, href: Column) -> Column:
    """A link's absolute URL. Absolute links stay native; only relative ones go to Python, as there is no built-in."""
    absolute = href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute, href).otherwise(F.pandas_udf(_joined, "string")(base, F.when(~absolute, href)))


def social_profiles(edges: DataFrame) -> DataFrame:
    """Per site and platform, the profile that most distinct pages link to; the first of equals."""
    platform = F.lit(None).cast("string")
    for p in PLATFORMS:
        platform = F.when((U.host(F.col("dst")) == p) | U.host(F.col("dst")).endswith("." + p), p).otherwise(platform)
    found = edges.withColumn("platform", platform).where("platform IS NOT NULL").where(F.size(U.segments(F.col("dst"))) > 0)
    counted = found.groupBy("domain", "platform", "dst").agg(F.count_distinct("src").alias("pages"), F.min("page_id").alias("first"))
    return counted.groupBy("domain", "platform").agg(F.max_by("dst", F.struct("pages", -F.col("first"))).alias("profile"), F.max("pages").alias("pages"))


def merge_queue(found: DataFrame, key: str, order: str, source: str, rank: str) -> DataFrame:
    """One entry for each key: its first order, its sources in order of first use, its greatest rank."""
    first = found.groupBy(key, source).agg(F.min(order).alias("__o"), F.max(rank).alias(rank))
    return first.groupBy(key).agg(F.min("__o").alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", source))), lambda x: x[source]), ",").alias("sources"), F.max(rank).alias(rank))


def near(text: Column, a: str, b: str, width: int) -> Column:
    """Whether two words occur within `width` characters of each other."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(rf"(^|[^a-z0-9])({a}[^a-z0-9](.{{0,{width}}}[^a-z0-9])?{b}|{b}[^a-z0-9](.{{0,{width}}}[^a-z0-9])?{a})([^a-z0-9]|$)")


def confidence(plan: DataFrame, group: str, tier: str) -> DataFrame:
    """high from three quarters of high or medium pages on, medium from 40 % on, else low."""
    share = F.avg(F.col(tier).isin("high", "medium").cast("double"))
    return plan.groupBy(group).agg(F.when(share >= 0.75, "high").when(share >= 0.4, "medium").otherwise("low").alias("confidence"))


def summary(people: DataFrame, group: str, department: str) -> DataFrame:
    """Per group: people, recognised departments, whether someone decides on technology."""
    return people.groupBy(group).agg(F.count(F.lit(1)).alias("people"), F.count_distinct(department).alias("departments"), F.coalesce(F.bool_or(F.col(department) == "Technology"), F.lit(False)).alias("has_technology"))


def all_pass(cases: DataFrame, group: str, ok: str) -> DataFrame:
    """Whether every case of a group passes; cases without a verdict do not."""
    return cases.groupBy(group).agg(F.bool_and(F.coalesce(F.col(ok), F.lit(False))).alias("passed"))


def top_sources(found: DataFrame, url: str, most: int = 6) -> DataFrame:
    """The most trusted directories among search results, one row for each brand (its first result), best first."""
    level = R.source_confidence(F.col(url))
    rank = F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)
    rows = found.select("ord", url, R.brand(F.col(url)).alias("brand"), level.alias("confidence"), rank.alias("__r")).where("confidence IS NOT NULL")
    first = rows.groupBy("brand").agg(F.min_by(F.struct(url, "confidence", "__r", "ord"), "ord").alias("f")).select("brand", "f.*")
    return first.orderBy(F.desc("__r"), "ord").limit(most).drop("__r")


def needs_recrawl(stored: DataFrame, links: DataFrame, site: str, page: str, target: str, trusted: int = 3) -> DataFrame:
    """(site, recrawl): sites with fewer than `trusted` pages of which no link is known, or a link is to a page that is not stored."""
    counts = stored.groupBy(site).agg(F.count(F.lit(1)).alias("__n"))
    known = links.groupBy(site).agg(F.count(F.lit(1)).alias("__links"))
    fresh = links.select(site, F.col(target).alias(page)).distinct().join(stored.select(site, page).distinct(), [site, page], "left_anti").select(site).distinct().withColumn("__new", F.lit(True))
    rows = counts.join(known, site, "left").join(fresh, site, "left")
    return rows.select(site, ((F.col("__n") < trusted) & (F.col("__links").isNull() | F.coalesce("__new", F.lit(False)))).alias("recrawl"))
