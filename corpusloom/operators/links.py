"""Link edges of raw pages, and what follows from them: in-degree, anchors, URL patterns, route plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import url as U

# Anchors that say nothing about their target.
GENERIC = "read more,learn more,click here,here,more,home,next,previous,back,menu".split(",")


#: A link with its text up to its end, or to the next link if it never ends; the target in double quotes, single ones or none.
LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>.*?(?=</a\s*>|<a\b|\z)"""
HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def edges(pages: DataFrame) -> DataFrame:
    """(page_id, domain, src, pos, dst, anchor) of every link; the anchor is the link's text without markup. Targets that begin with two slashes get the page's
    scheme, those that begin with one its host, relative ones its folder too; absolute ones are taken as they are; other schemes and places within
    the page are no links. What belongs to the page is worked out once a page, before the one generator; no shuffle, no Python."""
    url = F.col("url")
    parts = pages.select(
        "page_id", U.host(url).alias("domain"), U.normalize(url).alias("src"), U.scheme(url).alias("scheme"), U.path(url).alias("path"), F.regexp_extract_all("html", F.lit(LINK), F.lit(0)).alias("found")
    )
    raw = parts.withColumns({"base": F.concat("scheme", F.lit("://"), "domain"), "folder": F.concat(F.lit("/"), F.regexp_extract("path", "^/*(.*/)?[^/]*$", 1))}).select("page_id", "domain", "src", "scheme", "path", "base", "folder", F.posexplode("found").alias("pos", "a"))
    quoted = [F.nullif(F.regexp_extract("a", HREF, k), F.lit("")) for k in (1, 2, 3)]
    anchor = T.clean(F.regexp_replace(F.regexp_replace("a", r"(?s)^<[^>]*>", ""), r"(?s)<[^>]*>", " "))
    href = F.col("href")
    dst = (
        F.when(href.rlike("^(?i)https?://"), href).when(href.startswith("//"), F.concat("scheme", F.lit(":"), href)).when(href.startswith("/"), F.concat("base", U.without_dots(href)))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | href.rlike("^(#|$)"), F.lit(None)).when(href.startswith("?"), F.concat("base", "path", href)).otherwise(F.concat("base", U.without_dots(F.concat("folder", href))))
    )
    named = raw.select("*", F.trim(F.coalesce(*quoted, F.lit(""))).alias("href"), anchor.alias("anchor"))
    return named.select("page_id", "domain", "src", "pos", U.normalize(dst).alias("dst"), "anchor").where("dst <> '://'")


def in_degree(e: DataFrame) -> DataFrame:
    """Incoming edges of each target; several edges of one page count each."""
    return e.groupBy("domain", "dst").agg(F.count(F.lit(1)).alias("in_degree"), F.count_distinct("src").alias("n_sources"))


def anchors(e: DataFrame, most: int = 5) -> DataFrame:
    """Up to `most` distinct anchors of each target in order of first use, in their first casing, without generic ones."""
    kept = e.where((F.col("anchor") != "") & ~F.lower("anchor").isin(*GENERIC))
    first = kept.groupBy("dst", F.lower("anchor").alias("low")).agg(F.min(F.struct("page_id", "pos", "anchor")).alias("f"))
    w = Window.partitionBy("dst").orderBy("f.page_id", "f.pos")
    ranked = first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return ranked.groupBy("dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("f.anchor").alias("anchor")))), lambda x: x["anchor"]), "|").alias("anchors"))


def patterns(urls: DataFrame, least: int = 4) -> DataFrame:
    """Parent paths with `least` children or more."""
    segs = U.segments(F.col("url"))
    parent = F.when(F.size(segs) >= 2, F.concat(F.lit("/"), F.array_join(F.slice(segs, 1, F.size(segs) - 1), "/")))
    return urls.withColumn("parent", parent).where("parent IS NOT NULL").groupBy("domain", "parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("domain", F.concat("parent", F.lit("/*")).alias("pattern"), "n")


def route_plan(pages: DataFrame, degree: DataFrame, most: int = 8) -> DataFrame:
    """The best pages of each site: tier, links from elsewhere (up to 10) and length relative to the site's longest page."""
    kind = R.page_type(F.col("url"))
    rows = pages.select("page_id", U.host(F.col("url")).alias("domain"), U.normalize(F.col("url")).alias("page"), R.tier(F.col("url"), kind).alias("tier"), F.size(F.split(T.visible(F.col("html")), " ")).alias("n_words"))
    longest = rows.groupBy("domain").agg(F.max("n_words").alias("longest"))
    rows = rows.where("tier IS NOT NULL").join(longest, "domain")
    joined = rows.join(degree.select("domain", F.col("dst").alias("page"), "in_degree"), ["domain", "page"], "left")
    base = F.create_map(*[x for k, v in R.TIER_SCORES.items() for x in (F.lit(k), F.lit(v))])[F.col("tier")]
    score = base + F.least(F.coalesce("in_degree", F.lit(0)), F.lit(10)) + F.bround(8.0 * F.col("n_words") / F.greatest("longest", F.lit(1))).cast("int")
    w = Window.partitionBy("domain").orderBy(F.desc("score"), "page_id")
    return joined.withColumn("score", score.cast("int")).withColumn("priority", F.row_number().over(w)).where(F.col("priority") <= most).select("domain", "page_id", "tier", "score", "priority")


def boilerplate_lines(docs: DataFrame, group: str, ident: str, text: str, least: int = 2) -> DataFrame:
    """Lines that stand in `least` distinct documents of a group or more."""
    lines = docs.select(group, ident, F.explode(F.split(text, "\n")).alias("raw")).select(group, ident, T.clean(F.col("raw")).alias("line")).where("line <> ''")
    return lines.groupBy(group, "line").agg(F.count_distinct(ident).alias("n_docs")).where(F.col("n_docs") >= least)


def without_boilerplate(docs: DataFrame, group: str, ident: str, text: str, least: int = 2) -> DataFrame:
    """Texts without the lines that boilerplate_lines names; blank lines stay."""
    lines = docs.select(group, ident, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).withColumn("line", T.clean(F.col("raw")))
    bad = boilerplate_lines(docs, group, ident, text, least).select(group, "line")
    blank = F.col("line") == ""  # blank lines are never bad, and would be one hot key
    kept = lines.where(~blank).join(bad, [group, "line"], "left_anti").unionByName(lines.where(blank).select(group, "line", ident, "pos", "raw"))
    joined = kept.groupBy(group, ident).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("kept"))
    return docs.select(group, ident).join(joined, [group, ident], "left").withColumn("kept", F.coalesce("kept", F.lit("")))


def consecutive_lines(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Lines without blanks and without repeats of the line before: within a text, so no shuffle."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.clean), lambda x: x != "")
    one = docs.select(ident, F.inline(F.array(F.struct(lines.alias("lines")))))
    return one.select(ident, F.filter("lines", lambda x, i: (i == 0) | (F.get("lines", i - 1) != x)).alias("lines"))


def language_alternates(pages: DataFrame, ident: str, url: str, html: str) -> DataFrame:
    """(ident, code, href) of the language variants that a page declares, without x-default; of several of one code the last."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    attr = lambda name: F.regexp_extract("tag", rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    rows = pages.select(ident, url, F.posexplode(tags).alias("pos", "tag")).select(ident, url, "pos", attr("rel").alias("rel"), F.lower(F.trim(attr("hreflang"))).alias("code"), F.trim(attr("href")).alias("href"))
    good = rows.where(F.contains(F.lower("rel"), F.lit("alternate")) & (F.col("code") != "") & (F.col("code") != "x-default") & (F.col("href") != ""))
    base = F.concat(U.scheme(F.col(url)), F.lit("://"), U.netloc(F.col(url)))
    full = F.when(F.col("href").startswith("/"), F.concat(base, F.col("href"))).otherwise(F.col("href"))
    return good.groupBy(ident, "code").agg(F.max_by(full, "pos").alias("href"))


def without_other_languages(urls: DataFrame, url: str, alternates: DataFrame, site: str) -> DataFrame:
    """urls (with their `site`) without those below the first path segment of one of the site's own variants that is not English.
    The first segment decides, so the prefix test is an anti join on it."""
    own = (F.split("code", "-")[0] != "en") & (U.registered_domain(F.col("href")) == F.col(site)) & (F.size(U.segments(F.col("href"))) > 0)
    bad = alternates.where(own).select(F.col(site), U.segments(F.col("href"))[0].alias("__first")).distinct()
    return urls.withColumn("__first", F.get(U.segments(F.col(url)), 0)).join(bad, [site, "__first"], "left_anti").drop("__first")


def previews(candidates: DataFrame, contexts: DataFrame, texts: DataFrame, key: str, width: int = 600) -> DataFrame:
    """(key, preview): the page's context, else the beginning of its text (the preview's width is its feature), else nothing."""
    both = candidates.select(key).distinct().join(contexts.select(key, "context"), key, "left").join(texts.select(key, "text"), key, "left")
    return both.select(key, F.coalesce(F.nullif("context", F.lit("")), T.shorten(F.col("text"), width), F.lit("")).alias("preview"))


def navigation(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of pages and rows of patterns as one list of JSON objects; the usual place of a link (body) is left out."""
    rows = pages.select(F.lit("page").alias("kind"), F.col("url").alias("target"), "anchor", F.nullif("section", F.lit("body")).alias("section")).unionByName(found.select(F.lit("pattern").alias("kind"), F.col("pattern").alias("target"), "n"), allowMissingColumns=True)
    return rows.select("target", F.to_json(F.struct("kind", "target", "anchor", "section", "n")).alias("entry"))
