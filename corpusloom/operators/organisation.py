"""Technology rules, capabilities and signals; departments and likely ownership of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Technologies by category, name and pattern (of lower-case text); generic words count less than a vendor's own address.
_START, _END = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
TECH_RULES = (
    ("crm", "Salesforce", r"salesforce|force\.com|lightning\.force", 85), ("crm", "HubSpot", r"hubspot|hs-scripts\.com|hsforms", 85), ("crm", "Zoho", r"zoho\.com|zohopublic", 85),
    ("crm", "Microsoft Dynamics", r"dynamics\.com|dynamics[\s-]?365", 85), ("crm", "Pipedrive", r"pipedrive", 85), ("crm", "Freshworks", r"freshworks|freshsales|freshdesk", 85), ("crm", "Bitrix24", r"bitrix24", 85),
    ("login_system", "Login/Sign-in page", _START + r"(log[\s-]?in|sign[\s-]?in)" + _END, 55), ("login_system", "My Account", _START + r"my[\s-]?account" + _END, 55), ("login_system", "Client Portal", _START + r"client[\s-]?portal" + _END, 55),
    ("login_system", "Dashboard", _START + "dashboard" + _END, 55), ("login_system", "Member Area", _START + r"member[\s-]?(area|portal|login)" + _END, 55),
    ("payments", "Stripe", r"stripe\.com", 85), ("payments", "PayPal", r"paypal\.com|paypalobjects", 85), ("payments", "Square", r"squareup\.com|square\.site", 85), ("payments", "Authorize.net", r"authorize\.net", 85),
    ("payments", "Checkout", _START + "checkout" + _END, 55), ("payments", "Cart", _START + r"(shopping[\s-]?)?cart" + _END, 55), ("payments", "Buy Now", _START + r"buy[\s-]?now" + _END, 55),
    ("chat", "Intercom", r"intercom\.io|widget\.intercom", 85), ("chat", "Drift", r"drift\.com|js\.driftt\.com", 85), ("chat", "Crisp", r"crisp\.chat", 85), ("chat", "Zendesk", r"zendesk|zdassets", 85),
    ("chat", "Tawk.to", r"tawk\.to", 85), ("chat", "LiveChat", r"livechatinc|livechat\.com", 85),
    ("analytics", "Google Analytics", r"google-analytics\.com|gtag\(", 85), ("analytics", "GA4", r"googletagmanager\.com/gtag/js\?id=g-|" + _START + "g-[a-z0-9]{6,}" + _END, 85), ("analytics", "Google Tag Manager", r"googletagmanager\.com", 85),
    ("analytics", "Mixpanel", r"mixpanel\.com", 85), ("analytics", "Hotjar", r"hotjar\.com", 85), ("analytics", "Segment", r"segment\.(com|io)|cdn\.segment", 85), ("analytics", "Meta Pixel", r"connect\.facebook\.net[^\n]*fbevents|fbq\(", 85),
    ("authentication", "OAuth", _START + "oauth" + _END, 55), ("authentication", "Auth0", r"auth0\.com", 85), ("authentication", "Okta", r"okta\.com", 85), ("authentication", "Clerk", r"clerk\.(dev|com)", 85),
    ("authentication", "Firebase Auth", r"identitytoolkit\.googleapis\.com|firebaseapp\.com", 85),
)
# Signals of absence with their confidence.
ABSENCE = (("no_crm", "crm", 0.82), ("no_analytics", "analytics", 0.75), ("no_login", "login_system", 0.6))
# Departments by title words, in order of precedence.
DEPARTMENTS = (
    ("Executive", "ceo|chief executive|founder|owner|president|managing director|general manager"), ("Technology", "cto|chief technology|cio|chief information|it manager|technology manager|digital transformation|innovation manager"),
    ("Operations", "coo|chief operating|operations manager|marina manager"), ("Sales", "sales director|sales manager|business development"), ("Marketing", "cmo|chief marketing|marketing director|marketing manager"),
    ("Finance", "cfo|chief financial|finance manager"), ("Customer Success", "customer success|customer experience"), ("Support", "support manager|support"), ("Human Resources", "hr manager|human resources"),
    ("Executive", "director|vp|vice president"), ("Operations", "manager"),
)
# What a department is likely to own, and how surely.
OWNERSHIP = (
    ("Executive", "Digital Transformation", 0.85), ("Executive", "Cybersecurity", 0.55), ("Executive", "AI", 0.55), ("Technology", "Cybersecurity", 0.92), ("Technology", "Cloud Infrastructure", 0.92), ("Technology", "Digital Transformation", 0.9),
    ("Technology", "IoT", 0.85), ("Technology", "AI", 0.85), ("Technology", "Automation", 0.8), ("Operations", "ERP", 0.85), ("Operations", "Automation", 0.85), ("Operations", "IoT", 0.75), ("Sales", "CRM", 0.92), ("Sales", "Analytics", 0.6),
    ("Marketing", "Marketing Automation", 0.92), ("Marketing", "Website Redesign", 0.8), ("Finance", "ERP", 0.7), ("Finance", "Automation", 0.6), ("Customer Success", "Customer Experience", 0.92), ("Support", "Customer Experience", 0.85), ("Human Resources", "Automation", 0.5),
)


def detections(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, category, technology, confidence, ord) of each rule that matches; the text is lowered once for each row."""
    low = F.lower(F.coalesce(html, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(F.col("low").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("technology"), F.lit(k).alias("confidence"), F.lit(i).alias("ord"))) for i, (c, n, p, k) in enumerate(TECH_RULES)]))
    return pages.select(ident, F.inline(F.array(F.struct(low.alias("low"))))).select(ident, F.inline(hits))


def capabilities(found: DataFrame, group: str) -> DataFrame:
    """The surest technology of each category and group; the first rule of equals."""
    best = F.max_by("technology", F.struct("confidence", -F.col("ord")))
    return found.groupBy(group, "category").agg(F.max("confidence").alias("confidence"), best.alias("technology"))


def absence_signals(groups: DataFrame, caps: DataFrame, group: str) -> DataFrame:
    """(group, signal, confidence) for each category of which nothing is publicly detected."""
    wanted = groups.select(group, F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("category"), F.lit(k).alias("confidence")) for s, c, k in ABSENCE])))
    return wanted.join(caps.select(group, "category"), [group, "category"], "left_anti").select(group, "signal", "confidence")


# Front ends and hosts of a modern stack, and what it makes moot.
MODERN_FRONT, MODERN_HOSTS = ("React", "Next.js", "Vue.js", "Nuxt.js"), ("Cloudflare", "Vercel", "Netlify")
SUPPRESSED = ("legacy_wordpress", "outdated_version")


def sales_signals(profiles: DataFrame, group: str) -> DataFrame:
    """(group, signal, confidence, evidence) of profiles: technologies (array of category and name), capabilities (array of names
    that are detected), versions (array of texts), error (boolean). A modern stack suppresses the signals of an old one; a profile
    with an error has no signal of absence. Absences are never called findings."""
    names = lambda c: F.transform(F.filter("technologies", lambda t: t["category"] == c), lambda t: t["name"])
    some = lambda c, of: F.arrays_overlap(names(c), F.array(*[F.lit(x) for x in of]))
    lacks = lambda c: ~F.coalesce(F.col("error"), F.lit(False)) & ~F.array_contains("capabilities", c)
    modern = some("frontend", MODERN_FRONT) & some("hosting", MODERN_HOSTS) & (F.size(names("crm")) > 0)
    old = F.exists("versions", lambda v: F.when(v.rlike("^[0-9]{1,9}([.]|$)"), F.split(v, r"\.")[0].cast("int")) <= 5)
    rules = (
        ("modern_stack", modern, F.lit(0.8), "positively_detected"), ("no_crm", lacks("crm"), F.lit(0.82), "not_publicly_detected"), ("no_analytics", lacks("analytics"), F.lit(0.75), "not_publicly_detected"),
        ("no_customer_portal", lacks("customer_portal"), F.lit(0.65), "not_publicly_detected"), ("no_login", lacks("login_system"), F.lit(0.6), "not_publicly_detected"),
        ("legacy_wordpress", F.array_contains(names("cms"), "WordPress"), F.when(F.size(names("frontend")) == 0, 0.91).otherwise(0.6), "positively_detected"), ("outdated_version", F.coalesce(old, F.lit(False)), F.lit(0.7), "positively_detected"),
    )
    hits = F.array_compact(F.array(*[F.when(when & ~modern if name in SUPPRESSED else when, F.struct(F.lit(name).alias("signal"), k.alias("confidence"), F.lit(e).alias("evidence"))) for name, when, k, e in rules]))
    return profiles.select(group, F.inline(hits))


def cookies(headers: Column) -> Column:
    """Names and values of Set-Cookie headers (an array); malformed ones are left out, a later one of a name wins."""
    first = F.transform(headers, lambda h: F.trim(F.split(h, ";")[0]))
    good = F.filter(first, lambda x: x.rlike("^[^=\\s,;]+=[^\\s,;]*$"))
    pairs = F.transform(good, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, "^[^=]+=(.*)$", 1), '^"|"$', "").alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])))


def department(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in DEPARTMENTS:
        out = out.when(low.rlike(rf"(^|[^a-z0-9_])({words})([^a-z0-9_]|$)"), name)
    return out


def ownership(people: DataFrame, ident: str, most: int = 5, least: float = 0.5) -> DataFrame:
    """Problems that a person likely owns: the lesser of the person's and the mapping's confidence, `least` or more, the best `most`."""
    spark = people.sparkSession
    table = spark.createDataFrame([(d, c, float(k), i) for i, (d, c, k) in enumerate(OWNERSHIP)], "department string, category string, mapped double, ord int")
    joined = people.join(F.broadcast(table), "department").withColumn("likely", F.round(F.least("confidence", "mapped"), 3)).where(F.col("likely") >= least)
    rank = F.row_number().over(Window.partitionBy(ident).orderBy(F.desc("likely"), "ord"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= most).select(ident, "department", "category", "likely", "rank")
