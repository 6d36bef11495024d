"""People on pages: name and title lines, role mailboxes, profile links, and which sources of people count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import contacts, organisation

# Titles that make a line a title, words of title case that are no part of a name, and mailboxes by department.
TITLES = (
    "chief executive officer", "ceo", "founder", "co-founder", "cofounder", "owner", "managing director", "director", "president", "vice president", "vp",
    "chief technology officer", "cto", "chief information officer", "cio", "chief operating officer", "coo", "chief financial officer", "cfo", "chief marketing officer", "cmo",
    "general manager", "marina manager", "it manager", "digital transformation manager", "technology manager", "innovation manager", "customer experience manager",
    "customer success manager", "business development manager", "operations manager", "support manager", "hr manager", "human resources manager", "finance manager",
    "sales director", "marketing director",
)
NOT_NAMES = (
    "administrative", "business", "partner", "officer", "department", "associate", "specialist", "coordinator", "representative", "assistant", "team", "staff", "office",
    "division", "unit", "group", "committee", "board", "council", "services", "solutions", "support", "customer", "client", "product", "engineering", "human", "resources", "talent",
)
ROLE_MAILBOXES = (
    ("sales", "Sales"), ("marketing", "Marketing"), ("support", "Support"), ("help", "Support"), ("hr", "Human Resources"), ("careers", "Human Resources"), ("jobs", "Human Resources"),
    ("finance", "Finance"), ("billing", "Finance"), ("accounts", "Finance"), ("press", "Marketing"), ("media", "Marketing"), ("partnerships", "Sales"), ("business", "Sales"),
)
NAME = r"[A-Z][a-zA-Z'’\-]+(?:\s+[A-Z][a-zA-Z'’\-]+){1,3}"
TITLE = r"(?i)\b(" + "|".join(TITLES) + r"|head of [a-z ]{2,30}|[a-z ]{2,25} (manager|director))\b"
INLINE, STACKED, MAILBOX, MOST = 0.9, 0.78, 0.7, 15


def is_name(text: Column) -> Column:
    """Two to four words in title case, none of which is a word of offices and departments."""
    words = F.split(F.lower(text), r"\s+")
    return text.rlike(f"^{NAME}$") & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in NOT_NAMES]))


def named(pages: DataFrame, ident: str, text: str, most: int = MOST) -> DataFrame:
    """(ident, pos, name, role, department, confidence): "Name, Title" on a line, or a name on the line before a title. The first
    of a name counts, and the first `most` of a page. Lines stay within their row, so nothing is shuffled before names are told apart."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(F.ltrim(F.regexp_replace(x, r"^[#\-•\s]+", "")))), lambda x: x != "")
    rows = pages.select(ident, lines.alias("lines")).select(ident, F.posexplode(F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.get("lines", i - 1).alias("before")))).alias("pos", "l")).select(ident, "pos", "l.*")
    pair = rf"^({NAME})\s*[,|—–-]\s*(.+)$"
    head, tail = F.regexp_extract("line", pair, 1), F.regexp_extract("line", pair, 2)
    inline = (head != "") & tail.rlike(TITLE)
    stacked = F.col("line").rlike(TITLE) & F.coalesce(F.col("before"), F.lit("")).rlike(f"^{NAME}$")
    found = rows.select(ident, "pos", F.when(inline, head).when(stacked, F.col("before")).alias("name"), F.when(inline, F.trim(tail)).when(stacked, F.col("line")).alias("role"), F.when(inline, INLINE).otherwise(STACKED).alias("confidence"))
    real = found.where(F.col("name").isNotNull() & is_name(F.col("name")))
    first = real.groupBy(ident, F.lower("name").alias("low")).agg(F.min_by(F.struct("pos", "name", "role", "confidence"), "pos").alias("f")).select(ident, "f.*")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(ident).orderBy("pos"))).where(F.col("rank") <= most)
    return ranked.select(ident, "pos", "name", "role", organisation.department(F.col("role")).alias("department"), "confidence")


def role_mailboxes(pages: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, address, department, confidence) of mailboxes that a department reads."""
    local = F.split("address", "@")[0]
    department = F.lit(None).cast("string")
    for box, name in ROLE_MAILBOXES:
        department = F.when(local == box, name).otherwise(department)
    return contacts.addresses(pages, ident, text).withColumn("department", department).where("department IS NOT NULL").select(ident, "address", "department", F.lit(MAILBOX).alias("confidence"))


def profile_links(people: DataFrame, links: DataFrame, ident: str, host: str = "linkedin.com/in/") -> DataFrame:
    """Adds the first profile link of the person's page whose anchor contains the name or stands in it. Links are joined by page."""
    low, anchor = F.lower("name"), F.lower(F.trim("anchor"))
    mine = links.where(F.contains(F.lower("url"), F.lit(host))).select(ident, "pos", "url", "anchor").withColumnRenamed("pos", "__pos")
    hits = people.join(mine, ident).where((anchor != "") & (F.contains(low, anchor) | F.contains(anchor, low))).groupBy(ident, "name").agg(F.min_by("url", "__pos").alias("profile"))
    return people.join(hits, [ident, "name"], "left")


def merged(site: DataFrame, structured: DataFrame, searched: DataFrame, group: str) -> DataFrame:
    """People of the site and of its structured data; those of a search only for groups in which neither names anybody."""
    own = site.unionByName(structured, allowMissingColumns=True)
    groups = own.where("name IS NOT NULL").select(group).distinct()
    return own.unionByName(searched.join(groups, group, "left_anti"), allowMissingColumns=True)


def followers(snippet: Column) -> Column:
    """The number that a snippet gives before "followers", as it is written; null if none."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(snippet, F.lit("")), r"(?i)([\d,.]+\s?[KMB]?)\s+followers", 1)), F.lit(""))


def best_hit(hits: DataFrame, group: str, order: str, confidence: str, least: float = 0.72, sure: float = 0.95) -> DataFrame:
    """Search results of each group, from queries in order: the surest one of all queries up to the first that gives a nearly
    certain one, the earliest of equals; none if the best stays below `least`. `order` counts results over all queries, and `query`
    numbers the queries."""
    stop = hits.where(F.col(confidence) >= sure).groupBy(group).agg(F.min("query").alias("__stop"))
    tried = hits.join(stop, group, "left").where(F.col("__stop").isNull() | (F.col("query") <= F.col("__stop"))).drop("__stop")
    columns = [F.col(c) for c in tried.columns if c != group]
    return tried.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(confidence, -F.col(order))).alias("b")).select(group, "b.*").where(F.col(confidence) >= least)


def first_query_hit(hits: DataFrame, group: str) -> DataFrame:
    """The first result of the first query that has any."""
    columns = [F.col(c) for c in hits.columns if c != group]
    return hits.groupBy(group).agg(F.min_by(F.struct(*columns), F.struct("query", "position")).alias("b")).select(group, "b.*")
