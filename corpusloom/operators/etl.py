"""Site-level batch cleaning: profile, reason cascade, page dedup, rollup, exploration, governance.

Rows carry an ordinal (`ord`) wherever "first seen" decides, so results do not depend on the order of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import url as U

SEP = " | "
NONE = "N/A"


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, filled cells (neither blank nor N/A) and their share in percent. One pass."""
    filled = [F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin("", NONE) == F.lit(False)).alias(c) for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *filled)
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = one.selectExpr("n_rows", f"stack({len(columns)}, {stack}) as (column_name, filled)")
    return long.withColumn("fill_pct", F.when(F.col("n_rows") == 0, 0.0).otherwise(F.round(100.0 * F.col("filled") / F.col("n_rows"), 1)))


def crawl_rows(pages: DataFrame) -> DataFrame:
    """Index rows of raw pages: ord, site, domain, page_url, path, title, description, content_length."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    return pages.select(
        F.col("page_id").alias("ord"),
        U.strip_tracking(F.col("url")).alias("page_url"),
        F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url"))).alias("website_url"),
        U.host(F.col("url")).alias("domain"),
        U.path(F.col("url")).alias("path"),
        T.clean(title).alias("page_title"),
        F.length("html").alias("content_length"),
    )


def reject_reason(url: Column, title: Column, relevance: Column, length: Column, contact: Column, industry: tuple[Column, str] | None = None, place: tuple[Column, str] | None = None) -> Column:
    """First reason that applies, null if none. `industry` and `place` are what a row was validated for and what is asked for now;
    a row that was validated for nothing, or a request without them, gives no such reason."""
    low = F.lower(F.trim(F.coalesce(relevance, F.lit(""))))
    return (
        F.when(U.host(url) == "", "no_website")
        .when(R.classify_result(url, F.lit("")) != "official", "aggregator_domain")
        .when(R.is_utility(url), "utility_domain")
        .when((low != "") & (low != "match"), F.concat(F.lit("failed_relevance:"), low))
        .when(_other(industry), "validated_for_different_industry")
        .when(_other(place), "validated_for_different_location")
        .when((F.coalesce(length, F.lit(0)) == 0) & ~contact, "empty_no_contact")
    )


def _other(pair: tuple[Column, str] | None) -> Column:
    if pair is None or not pair[1].strip():
        return F.lit(False)
    have = F.lower(F.trim(F.coalesce(pair[0], F.lit(""))))
    return (F.coalesce(pair[0], F.lit("")) != "") & (have != pair[1].strip().lower())


def dedupe_pages(rows: DataFrame, keys: list[str], richness: Column) -> DataFrame:
    """The richest row of each key; the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(richness.desc(), F.col("ord").asc())
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def rollup(rows: DataFrame) -> DataFrame:
    """One row a site: most frequent title (first seen of equals), home page (shortest path), number of pages, pages in
    order of path length. Titles are counted per site and title first, so both steps combine before the shuffle."""
    length = F.length(F.regexp_replace("path", r"/+$", ""))
    names = rows.where("page_title <> ''").groupBy("domain", "page_title").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    name = names.groupBy("domain").agg(F.max_by("page_title", F.struct("n", -F.col("first"))).alias("company_name"))
    sites = rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("num_pages"),
        F.min_by("page_url", F.struct(length, F.col("ord"))).alias("home_url"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(length.alias("l"), "ord", "page_url"))), lambda x: x["page_url"])), SEP).alias("pages_scraped"),
    )
    return sites.join(name, "domain", "left").withColumn("company_name", F.coalesce("company_name", "domain"))


def explore(sites: DataFrame, email: str, phone: str) -> DataFrame:
    """Number of sites and coverage of contacts."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    have = lambda c: F.count_if(F.col(c) != NONE)
    return sites.agg(F.count(F.lit(1)).alias("businesses"), have(email).alias("with_email"), F.round(100.0 * have(email) / n, 1).alias("email_pct"), have(phone).alias("with_phone"), F.round(100.0 * have(phone) / n, 1).alias("phone_pct"))


def top_tlds(sites: DataFrame, k: int = 5) -> DataFrame:
    tld = F.element_at(F.split("domain", r"\."), -1).alias("tld")
    return sites.where(F.contains("domain", F.lit("."))).groupBy(tld).agg(F.count(F.lit(1)).alias("n"), F.min("domain").alias("first")).orderBy(F.desc("n"), "first").limit(k).select("tld", "n")


def govern(rows: DataFrame, email: str, phone: str, pages: str, valid: Column) -> DataFrame:
    """Adds _reason (hard problems) and _warnings (all problems), each joined by a semicolon."""
    hard = F.array_compact(F.array(F.when(F.col("domain") == "", "missing_domain"), F.when((F.col(email) != NONE) & ~valid, "bad_email"), F.when(F.col(pages) < 1, "no_pages")))
    soft = F.array_compact(F.array(F.when((F.col(email) == NONE) & (F.col(phone) == NONE), "no_contact")))
    return rows.withColumn("_reason", F.array_join(hard, ";")).withColumn("_warnings", F.array_join(F.concat(hard, soft), ";"))


def scope(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Semi join on a key; an empty scope lets everything pass."""
    return rows if wanted.isEmpty() else rows.join(wanted, key, "left_semi")


def merge_detections(left: DataFrame, right: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """Full outer merge by key: the greatest value, and the sorted union of labels."""
    both = left.select(key, value, label).unionByName(right.select(key, value, label))
    return both.groupBy(key).agg(F.max(value).alias(value), F.array_join(F.array_sort(F.collect_set(label)), ",").alias(label))
