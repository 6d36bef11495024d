"""Business e-mail addresses of raw pages: thirteen collectors, each with the trust its hiding place deserves, then validation, scores and ranking.

All collectors are column expressions over the page and run only where their mark stands; a page's finds are one array, so there is one generator and one
aggregate by (page, address). Of several finds of an address the most trusted gives source and base score, the first of equals. A total is the base, plus what the
address says for itself, plus DELIVERABLE where the domain is known to take mail; where it is known not to, the address goes.

Defined cases: null pages have no addresses; addresses are in lower case; equal totals are ranked by base, then by the order in which collectors and pages name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import contacts as C

# How much each source is trusted.
TRUST = {
    "cf_email": 95, "mailto": 90, "mailto_inline": 80, "json_ld": 88, "json_script": 78, "meta_tag": 82, "attr": 75, "visible_text": 70, "obfuscated": 72, "rot13": 60, "raw_html": 62, "html_comment": 65,
    "base64": 68,
}
# Names of JSON fields with addresses, attributes with addresses, parts of placeholders.
JSON_KEYS = "email email_address emailaddress emailAddress contactEmail contact_email replyto reply_to".split()
ATTRIBUTES = "value placeholder content aria-label title alt data-email data-contact data-address data-mailto".split()
PLACEHOLDERS = ("example.", "yourdomain", "@domain.com", "email@", "sentry", "wixpress", ".png", ".jpg", ".gif", ".svg", "@2x", "name@", "user@", "your@", "placeholder")
# Top-level domains of more than two letters that are taken for real where no table of suffixes is given.
GENERIC = "com org net edu gov mil int info biz name pro aero coop museum mobi jobs travel tel cat asia post xxx app dev shop store online site tech blog cloud agency studio company email group world life live news media design digital global solutions services systems support center club cafe restaurant hotel boats yachts marine".split()
DELIVERABLE = 25

#: An address between characters that are in none.
ADDRESS = r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,})(?![A-Za-z0-9._%+\-])"
# Ways to write an address for people only, and an address in source code.
WRITTEN_OUT = (
    r"(?i)[a-z0-9._%+\-]{1,64}\s*(?:\[at\]|\(at\)|@| at )\s*[a-z0-9.\-]{1,63}\s*(?:\[dot\]|\(dot\)|\.| dot )\s*[a-z]{2,}",
    r"(?i)[a-z0-9._%+\-]{1,64}\s*(?:_at_| at )\s*[a-z0-9.\-]+\.[a-z]{2,}",
    r"[A-Za-z0-9._%+\-]{1,64}＠[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
)
IN_SOURCE = r"""(?<=["':=\s>])([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,63}\.[A-Za-z]{2,})(?=["'\s<\\,;])"""

_SCRIPT, _LD = r"(?is)<script\b(?![^>]*application/ld\+json)[^>]*>(.*?)</script>", r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"


def _all(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def _each(parts: Column, found) -> Column:
    return F.flatten(F.transform(parts, found))


def plain(written: Column) -> Column:
    """An address that is written out, as an address."""
    at = F.regexp_replace(F.regexp_replace(F.trim(written), "＠", "@"), r"(?i)\s*(?:\[at\]|\(at\)|_at_| at )\s*", "@")
    return F.lower(F.regexp_replace(F.regexp_replace(at, r"(?i)\s*(?:\[dot\]|\(dot\)| dot )\s*", "."), r"\s+", ""))


def _attributes(source: Column) -> Column:
    """(address, source) of the attributes that may hold one."""
    tags = _all(source, r"(<[A-Za-z][^>]*@[^>]*>)")
    pairs = _each(tags, lambda t: _all(t, r"""([A-Za-z_:][A-Za-z0-9_:.\-]*\s*=\s*(?:"[^"]*@[^"]*"|'[^']*@[^']*'))"""))
    name = lambda p: F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1))
    wanted = F.filter(pairs, lambda p: name(p).isin(*ATTRIBUTES) | name(p).startswith("data-") | F.contains(name(p), F.lit("mail")))
    return _each(wanted, lambda p: F.transform(_all(F.regexp_extract(p, r"(?s)=\s*.(.*).$", 1), ADDRESS), lambda a: F.struct(a.alias("address"), F.concat(F.lit("attr:"), name(p)).alias("source"))))


def finds(html: Column) -> Column:
    """All finds of a page in order: an array of (address, source), neither validated nor distinct."""
    raw = F.coalesce(html, F.lit(""))
    decoded = C.decode_entities(raw)
    keys = "|".join(JSON_KEYS)
    tag = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1>"
    visible = F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded, tag, " "), r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    strings = F.concat(F.regexp_replace(F.regexp_replace(decoded, r"(?s)<!--.*?-->", " "), r"<[^>]*>", "\n"), F.lit("\n"), F.array_join(_all(decoded, r"(?s)<!--(.*?)-->"), "\n"))
    attr = lambda t, n: F.coalesce(F.nullif(F.regexp_extract(t, rf'(?is)\b{n}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(t, rf"(?is)\b{n}\s*=\s*'([^']*)'", 1))
    ld = F.filter(_all(raw, _LD), lambda s: F.try_parse_json(s).isNotNull())
    unescaped = lambda v: F.coalesce(F.get_json_object(F.concat(F.lit('["'), v, F.lit('"]')), "$[0]"), v)
    metas = F.filter(_all(decoded, r"(?is)(<meta\b[^>]*>)"), lambda t: F.contains(F.lower(F.coalesce(F.nullif(attr(t, "name"), F.lit("")), attr(t, "property"))), F.lit("email")) & F.contains(attr(t, "content"), F.lit("@")))
    named = lambda found, source: F.transform(found, lambda a: F.struct(a.alias("address"), F.lit(source).alias("source")))
    stages = (
        ("data-cfemail", named(F.filter(F.transform(_all(raw, r"(?i)data-cfemail\s*=\s*[\"']([0-9a-f]+)"), lambda x: F.coalesce(C.decode_xor(x), F.lit(""))), lambda x: F.contains(x, F.lit("@"))), "cf_email")),
        ("(?i)mailto:", named(_all(decoded, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']\s*mailto:([^"'?]*)"""), "mailto")),
        ("(?i)mailto:", named(F.transform(_all(decoded, r"""(?i)mailto:([a-z0-9._%+\-]{1,64}@[^\s"'<>]{3,})"""), lambda x: F.regexp_replace(F.split(x, r"\?")[0], "[.,;)]+$", "")), "mailto_inline")),
        ("ld\\+json", named(_each(ld, lambda s: F.transform(_all(s, rf'(?<!\\)"(?:{keys})"\s*:\s*"((?:[^"\\]|\\.)*)"'), unescaped)), "json_ld")),
        ("(?i)<script", named(_each(_all(raw, _SCRIPT), lambda s: _all(s, rf"""(?i)["']?(?:{keys})["']?\s*:\s*["']([^"'{{}}]+@[^"'{{}}]+)["']""")), "json_script")),
        ("(?i)<meta", named(F.transform(metas, lambda t: F.trim(attr(t, "content"))), "meta_tag")),
        ("<[^>]*@[^>]*>", _attributes(decoded)),
        ("@", named(_all(visible, ADDRESS), "visible_text")),
        *[(gate, named(F.transform(_all(decoded, p, 0), plain), "obfuscated")) for gate, p in zip((r"(?i)@|\[at\]|\(at\)| at ", "(?i)_at_| at ", "＠"), WRITTEN_OUT, strict=True)],
        ("@", named(_all(decoded, ADDRESS), "rot13")),  # turned by 13 places and back, letters are letters: an address is found wherever one stands
        ("@", named(_all(decoded, IN_SOURCE), "raw_html")),
        ("@", named(_all(strings, ADDRESS), "html_comment")),
        ("(?i)<script", named(_each(F.filter(F.transform(_each(_all(raw, r"(?is)<script\b[^>]*>(.*?)</script>"), lambda s: _all(s, r"""(?i)(?:email|contact|mailto|atob\s*\()\s*["']([A-Za-z0-9+/]{20,}={0,2})["']""")), C.decode_base64), lambda x: x.isNotNull()), lambda x: _all(x, ADDRESS)), "base64")),
    )
    none = F.array().cast("array<struct<address:string,source:string>>")
    return F.concat(*[F.coalesce(F.when(decoded.rlike(gate), found), none) for gate, found in stages])


def real_domain(domain: Column) -> Column:
    """A shape test that stands in for a table of public suffixes: a country's two letters or a known generic domain after a name."""
    last = F.element_at(F.split(domain, r"\."), -1)
    return domain.rlike(r"^[^.]+(\.[^.]+)+$") & last.rlike("^[a-z]+$") & ((F.length(last) == 2) | last.isin(*GENERIC))


def is_valid(address: Column, real: Column | None = None) -> Column:
    """No placeholder, no throw-away domain, a sound name, and a real domain (by default judged by its shape)."""
    local, domain = F.split_part(address, F.lit("@"), F.lit(1)), F.regexp_extract(address, "^[^@]*@(.*)$", 1)
    bad = F.lit(False)
    for part in PLACEHOLDERS:
        bad = bad | F.contains(address, F.lit(part))
    odd = (local == "") | F.contains(local, F.lit("..")) | local.startswith(".") | local.endswith(".") | domain.isin(*C.THROWAWAY)
    return F.contains(address, F.lit("@")) & ~bad & ~odd & (real_domain(domain) if real is None else real)


def collected(pages: DataFrame, ident: str, html: str, real=real_domain) -> DataFrame:
    """(ident, address, source, base, first): valid addresses once each; `first` is the place of their first find. `real(domain)` judges domains."""
    each = pages.select(ident, F.posexplode(finds(F.col(html))).alias("pos", "f")).select(ident, "pos", F.lower(F.trim("f.address")).alias("address"), "f.source")
    trust = F.create_map(*[x for k, v in TRUST.items() for x in (F.lit(k), F.lit(v))])[F.split(F.col("source"), ":")[0]]
    valid = each.where(is_valid(F.col("address"), real(F.regexp_extract("address", "^[^@]*@(.*)$", 1)))).withColumn("base", trust)
    best = valid.groupBy(ident, "address").agg(F.max_by("source", F.struct("base", -F.col("pos"))).alias("source"), F.max("base").alias("base"), F.min("pos").alias("first"))
    return best


def own_domain(domain: Column, site: Column) -> Column:
    """Whether a domain is the site's, above it or below it."""
    bare = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"^www\.", "")
    a, s = bare(domain), bare(site)
    return (a != "") & (s != "") & ((a == s) | a.endswith(F.concat(F.lit("."), s)) | s.endswith(F.concat(F.lit("."), a)))


def ranked(found: DataFrame, ident: str, site: Column, mail: DataFrame | None = None) -> DataFrame:
    """collected() with score and rank. `mail` (domain, mx_ok) says which domains take mail; domains it does not know cost nothing."""
    rows = found.withColumn("domain", F.regexp_extract("address", "^[^@]*@(.*)$", 1))
    rows = rows.withColumn("mx_ok", F.lit(None).cast("boolean")) if mail is None else rows.join(mail.select("domain", "mx_ok").dropDuplicates(["domain"]), "domain", "left")
    kept = rows.where(F.coalesce("mx_ok", F.lit(True)))
    local = F.split_part("address", F.lit("@"), F.lit(1))
    known = F.coalesce(site, F.lit("")) != ""
    where = F.when(own_domain(F.col("domain"), site), 50).when(F.regexp_replace("domain", r"^www\.", "").isin(*C.FREE), -30).when(known, -40).otherwise(0)
    who = F.when(local.isin(*C.ROLES), 30).when(local.rlike(r"^[a-z]+[._][a-z]+$"), 15).otherwise(0)
    total = F.col("base") + 50 + where + who + F.when(local.isin(*C.UNREAD), -80).otherwise(0) + F.when(F.col("mx_ok"), DELIVERABLE).otherwise(0)
    order = Window.partitionBy(ident).orderBy(F.desc("score"), F.desc("base"), "first")
    return kept.withColumn("score", total.cast("int")).withColumn("own", ~known | own_domain(F.col("domain"), site) | F.col("domain").isin(*C.FREE)).withColumn("rank", F.row_number().over(order))


def best(ranks: DataFrame, ident: str, least: int = 0) -> DataFrame:
    """(ident, address, score): the first address of the site's own domain or a free provider that scores `least` or more; else the first of all."""
    good = F.col("own") & (F.col("score") >= least)
    return ranks.groupBy(ident).agg(F.min(F.struct((~good).alias("late"), "rank", "address", "score")).alias("b")).select(ident, "b.address", "b.score")


def all_addresses(ranks: DataFrame, ident: str, most: int = 6) -> DataFrame:
    """(ident, addresses): up to `most` addresses of the site's own domain or free providers in order of rank; if there is none, the first of the others."""
    of = Window.partitionBy(ident, "own").orderBy("rank")
    kept = ranks.withColumn("n", F.row_number().over(of)).where(F.col("n") <= F.when(F.col("own"), most).otherwise(1))
    lists = kept.groupBy(ident).agg(F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("rank", "address")))).alias("a"), F.array_sort(F.collect_list(F.when(~F.col("own"), F.struct("rank", "address")))).alias("b"))
    return lists.select(ident, F.transform(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")), lambda x: x["address"]).alias("addresses"))
