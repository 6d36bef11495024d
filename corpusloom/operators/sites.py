"""Site-level unions: contacts, keywords, people by department, technology grids, handles of profiles, and selections with a floor."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from . import contacts, scoring

SEP, NONE = " | ", "N/A"
# Weights of a row's contacts beside its length, and the most phones of a site.
EMAIL_WEIGHT, PHONE_WEIGHT, MOST_PHONES = 5000, 2000, 8
DEPARTMENTS = ("Executive", "Technology", "Operations", "Sales", "Marketing", "Finance", "Customer Success", "Support", "Human Resources")
# First path segments that are no profile.
NO_PROFILE = ("share", "sharer", "sharer.php", "intent", "login", "signup", "help", "about", "privacy", "terms", "search", "hashtag", "explore", "p", "reel", "reels", "stories", "watch", "status", "posts", "photo", "photos", "events", "groups", "plugins", "dialog", "embed", "tr")


def clean_cell(s: Column) -> Column:
    """White space collapsed and wrongly decoded text repaired; null is empty."""
    return T.clean(scoring.fix_mojibake(F.coalesce(s, F.lit(""))))


def clean_multi(s: Column, valid, lower: bool = False) -> Column:
    """The valid values of a cell that joins several, in order and once each; N/A if none is."""
    parts = F.transform(F.split(F.coalesce(s, F.lit("")), r"\|"), lambda x: F.trim(x))
    parts = F.transform(parts, F.lower) if lower else parts
    good = F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != NONE) & valid(x)))
    return F.when(F.size(good) == 0, NONE).otherwise(F.array_join(good, SEP))


def richness(length: Column, email: Column, phone: Column) -> Column:
    """How much a copy of a page is worth: its length, and its contacts."""
    have = lambda c: (F.coalesce(c, F.lit("")) != "") & (c != NONE)
    return F.coalesce(length, F.lit(0)) + F.when(have(email), EMAIL_WEIGHT).otherwise(0) + F.when(have(phone), PHONE_WEIGHT).otherwise(0)


def values(rows: DataFrame, group: str, cell: str, order: str) -> DataFrame:
    """(group, value, rank): distinct values of joined cells by first use. Values are told apart before they are ranked, so a site of
    any number of rows stays in many tasks."""
    each = rows.select(group, order, F.posexplode(F.split(F.coalesce(F.col(cell), F.lit("")), r"\s*\|\s*")).alias("__p", "value")).where((F.col("value") != "") & (F.col("value") != NONE))
    first = each.groupBy(group, "value").agg(F.min(F.struct(order, "__p")).alias("__f"))
    return first.select(group, "value", F.row_number().over(Window.partitionBy(group).orderBy("__f")).alias("rank"))


def site_contacts(rows: DataFrame, group: str, order: str, email: str, phone: str, address: str) -> DataFrame:
    """One row a site: its addresses (own and free ones if it has any, else all), at most MOST_PHONES phones, and the first address
    that is given."""
    mail = values(rows, group, email, order)
    domain = F.element_at(F.split("value", "@"), -1)
    near = (domain == F.col(group)) | domain.endswith(F.concat(F.lit("."), F.col(group))) | domain.isin(*contacts.FREE)
    mail = mail.withColumn("__near", near).withColumn("__any", F.max("__near").over(Window.partitionBy(group))).where(F.col("__near") | ~F.col("__any"))
    joined = lambda df, name: df.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), SEP).alias(name))
    phones = values(rows, group, phone, order).where(F.col("rank") <= MOST_PHONES)
    place = rows.where((F.coalesce(F.col(address), F.lit("")) != "") & (F.col(address) != NONE)).groupBy(group).agg(F.min_by(address, order).alias("address"))
    out = rows.select(group).distinct()
    for part in (joined(mail, "emails"), joined(phones, "phones"), place):
        out = out.join(part, group, "left")
    return out.na.fill(NONE, ["emails", "phones", "address"])


def keyword_union(rows: DataFrame, group: str, hits: str) -> DataFrame:
    """(group, keywords): the keywords found on any page of a site, sorted."""
    each = rows.select(group, F.explode(hits).alias("k")).distinct()
    return rows.select(group).distinct().join(each.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keywords")), group, "left").na.fill("", ["keywords"])


def organisation(people: DataFrame, group: str) -> DataFrame:
    """(group, department, n) for the known departments and one for people of none; departments without people have no row."""
    known = F.when(F.col("department").isin(*DEPARTMENTS), F.col("department")).otherwise("Unclassified")
    return people.groupBy(group, known.alias("department")).agg(F.count(F.lit(1)).alias("n"))


def summary(people: DataFrame, group: str) -> DataFrame:
    """Per site: people with a name, sources in order, departments, and whether an executive, a technologist and a profile are known."""
    has = lambda d: F.coalesce(F.bool_or(F.col("department") == d), F.lit(False))
    return people.groupBy(group).agg(
        F.count_if(F.col("name").isNotNull()).alias("named"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("department").alias("departments"),
        has("Executive").alias("has_executive"), has("Technology").alias("has_technology"), F.coalesce(F.bool_or(F.col("profile").isNotNull()), F.lit(False)).alias("has_profile"),
    )


def grid(sites: DataFrame, caps: DataFrame, group: str, categories: list[str]) -> DataFrame:
    """Every category of every site: detected with its technology, or not_publicly_detected. The categories are an array in the row."""
    all_ = sites.select(group, F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    joined = all_.join(caps.select(group, "category", "technology", "confidence"), [group, "category"], "left")
    return joined.select(group, "category", F.when(F.col("technology").isNull(), "not_publicly_detected").otherwise("detected").alias("status"), "technology", "confidence")


def categories_view(found: DataFrame, group: str) -> DataFrame:
    """(group, category, technologies): names sorted, those of no category under Uncategorized."""
    rows = found.select(group, F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")).alias("category"), "technology").distinct()
    return rows.groupBy(group, "category").agg(F.array_join(F.array_sort(F.collect_list("technology")), ",").alias("technologies"))


def is_profile(url: Column) -> Column:
    """Whether a link on a platform is a profile: a path that does not begin or end with a word of posts, help and sharing."""
    segs = F.transform(U.segments(url), F.lower)
    return (F.size(segs) > 0) & (F.size(segs) <= 3) & ~F.coalesce(F.get(segs, 0).isin(*NO_PROFILE), F.lit(True)) & ~F.coalesce(F.get(segs, 1).isin(*NO_PROFILE), F.lit(False))


def handle(url: Column) -> Column:
    """The name that a profile's address gives: after in, company, channel, c or user the second segment, else the first, without @."""
    segs = U.segments(url)
    first = F.lower(F.get(segs, 0))
    return F.regexp_replace(F.when(first.isin("in", "company", "channel", "c", "user", "school", "showcase", "pages"), F.get(segs, 1)).otherwise(F.get(segs, 0)), "^@", "")


def chosen(scored: DataFrame, group: str, score: str, order: str, wanted: Column, most: int, least: int) -> DataFrame:
    """At most `most` of the wanted rows by score, topped up with the best others to `least`."""
    ranked = scored.withColumn("__w", wanted).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__w"), F.desc(score), order)))
    return ranked.where((F.col("__w") & (F.col("rank") <= most)) | (F.col("rank") <= least)).drop("__w")


def best_address(ranked: DataFrame, ident: str, site: Column, least: int = 0) -> DataFrame:
    """The best address on the site's own or a free domain whose score is `least` or more, else the best of all."""
    domain = F.element_at(F.split("address", "@"), -1)
    good = ((domain == site) | domain.endswith(F.concat(F.lit("."), site)) | domain.isin(*contacts.FREE)) & (F.col("score") >= least)
    return ranked.groupBy(ident).agg(F.min_by(F.struct("address", "score"), F.struct(~good, F.col("rank"))).alias("b")).select(ident, "b.*")


def within(text: Column, words: list[str], width: int) -> Column:
    """Whether whole words, in any order, begin and end within `width` characters; for three words at most a few orders are tried."""
    low = F.lower(F.coalesce(text, F.lit("")))
    gap = rf"(?=.{{0,{width}}})"
    orders = ["[^a-z0-9](?:.*?[^a-z0-9])?".join(p) for p in permutations(words)]
    found = F.lit(False)
    for o in orders:
        spans = F.regexp_extract_all(low, F.lit(rf"(?s)(?<![a-z0-9])(?=({o.replace('.*?', f'.{{0,{width}}}?')})(?![a-z0-9])){gap}"), F.lit(1))
        found = found | F.exists(spans, lambda s: F.length(s) <= width)
    return found
