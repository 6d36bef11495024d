"""JSON-LD of raw pages as VARIANT values: nodes, organisations, people, contact points, postal addresses.

Scripts are parsed once (`try_parse_json`; what is no JSON has no nodes) and walked level by level within the row: a list gives its items, a @graph its nodes, anything else
stays. So a page's nodes are one array in document order, one generator makes them rows, and no Python runs. Lists and graphs may be nested LEVELS deep, members of
addresses DEEP levels; VARIANT keeps an object's members by name, so among members "first" goes by name.

Defined cases: null pages, broken JSON and scalars have no nodes; values that are no strings are read as text; a missing field is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS, DEEP = 6, 8
# Types of people and organisations, parts of a postal address in order, the trust in what a site says of its people.
PEOPLE, ORGANISATIONS = ("person", "employee"), ("organization", "corporation", "localbusiness")
POSTAL = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
CONFIDENCE = 0.95

_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def field(node: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f'$["{name}"]', kind)


def text(node: Column, name: str) -> Column:
    """A field as text; objects and lists are none."""
    plain = field(node, name, "array<variant>").isNull() & field(node, name, "map<string,variant>").isNull()
    return F.when(plain, field(node, name))


def as_list(node: Column, name: str) -> Column:
    """A field's items; a single value is a list of one, a missing one an empty list."""
    none = F.array().cast("array<variant>")
    return F.coalesce(field(node, name, "array<variant>"), F.when(field(node, name, "variant").isNotNull(), F.array(field(node, name, "variant"))), none)


def kind(node: Column) -> Column:
    """The first type, in lower case; empty without one."""
    return F.lower(F.coalesce(F.when(field(node, "@type", "array<variant>").isNotNull(), F.try_variant_get(node, '$["@type"][0]', "string")).otherwise(text(node, "@type")), F.lit("")))


def _blocks(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, block, root) of each JSON-LD script."""
    found = pages.where(F.col(html).contains("ld+json")).select(ident, F.posexplode(F.regexp_extract_all(html, F.lit(_LD), F.lit(1))).alias("block", "raw"))
    return found.select(ident, "block", F.try_parse_json("raw").alias("root")).where("root IS NOT NULL")


def nodes(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, block, pos, kind, node): the objects of each page's JSON-LD in order."""
    level = F.array("root")
    for _ in range(LEVELS):
        level = F.flatten(F.transform(level, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(field(v, "@graph", "variant").isNotNull(), F.array(field(v, "@graph", "variant"))), F.array(v))))
    each = _blocks(pages, ident, html).select(ident, "block", F.posexplode(level).alias("pos", "node"))
    return each.where(F.try_variant_get("node", "$", "map<string,variant>").isNotNull()).select(ident, "block", "pos", kind(F.col("node")).alias("kind"), "node")


def organisations(found: DataFrame, ident: str) -> DataFrame:
    """(ident, name, type, description, url, logo, address) of the first organisation of each page; the address as JSON."""
    v = F.col("node")
    rows = found.where(F.col("kind").isin(*ORGANISATIONS)).select(
        ident, F.struct("block", "pos").alias("at"),
        F.struct(text(v, "name").alias("name"), F.col("kind").alias("type"), text(v, "description").alias("description"), text(v, "url").alias("url"), F.coalesce(F.try_variant_get(v, "$.logo.url", "string"), text(v, "logo")).alias("logo"), F.to_json(field(v, "address", "variant")).alias("address")).alias("o"),
    )
    return rows.groupBy(ident).agg(F.min_by("o", "at").alias("o")).select(ident, "o.*")


def _person(v: Column, role: Column) -> Column:
    profile = F.filter(as_list(v, "sameAs"), lambda u: F.contains(F.lower(F.coalesce(F.try_variant_get(u, "$", "string"), F.lit(""))), F.lit("linkedin.com")))
    return F.struct(
        text(v, "name").alias("name"), role.alias("role"), text(v, "email").alias("email"), text(v, "telephone").alias("phone"), F.try_variant_get(F.get(profile, 0), "$", "string").alias("linkedin"),
        F.coalesce(F.try_variant_get(v, "$.image.url", "string"), text(v, "image")).alias("photo"), F.lit("schema").alias("source"), F.lit(CONFIDENCE).alias("confidence"),
    )


def people(found: DataFrame, ident: str) -> DataFrame:
    """(ident, block, pos, n, name, role, email, phone, linkedin, photo, source, confidence): people, then founders and employees of organisations, each with a name."""
    v = F.col("node")
    own = F.when(F.col("kind").isin(*PEOPLE), F.array(_person(v, text(v, "jobTitle"))))
    named = lambda items, role: F.transform(items, lambda p: _person(p, F.coalesce(F.nullif(text(p, "jobTitle"), F.lit("")), F.lit(role))))
    staff = F.when(F.col("kind").isin(*ORGANISATIONS), F.concat(named(as_list(v, "founder"), "Founder"), F.transform(as_list(v, "employee"), lambda p: _person(p, text(p, "jobTitle")))))
    rows = found.where(F.col("kind").isin(*PEOPLE, *ORGANISATIONS)).select(ident, "block", "pos", F.posexplode(F.coalesce(own, staff)).alias("n", "p"))
    return rows.where(F.coalesce("p.name", F.lit("")) != "").select(ident, "block", "pos", "n", "p.*")


def contact_points(found: DataFrame, ident: str) -> DataFrame:
    """(ident, block, pos, n, phone, email, contact_type) of organisations."""
    rows = found.where(F.col("kind").isin(*ORGANISATIONS)).select(ident, "block", "pos", F.posexplode(as_list(F.col("node"), "contactPoint")).alias("n", "c")).where(F.try_variant_get("c", "$", "map<string,variant>").isNotNull())
    c = F.col("c")
    return rows.select(ident, "block", "pos", "n", text(c, "telephone").alias("phone"), text(c, "email").alias("email"), text(c, "contactType").alias("contact_type"))


def one_line(address: Column) -> Column:
    """A postal address in one line; a part that is an object is its name."""
    parts = [F.trim(F.coalesce(F.try_variant_get(address, f"$.{k}.name", "string"), text(address, k), F.lit(""))) for k in POSTAL]
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ", ")


def postal_addresses(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, address): the first postal address that is not empty, or `address` text of eight characters or more, wherever it stands in a page's JSON-LD; of an
    object's members `address` comes first."""
    none = F.array().cast("array<struct<i:int,v:variant>>")
    level = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.col("root").alias("v")))
    levels = [level]
    items = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda c, i: F.struct(i.alias("i"), c.alias("v")))
    members = lambda v: F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e, i: F.struct(F.when(e["key"] == "address", -1).otherwise(i).alias("i"), e["value"].alias("v")))
    for _ in range(DEEP):
        level = F.flatten(F.transform(level, lambda x: F.transform(F.coalesce(items(x["v"]), members(x["v"]), none), lambda c: F.struct(F.concat(x["path"], F.array(c["i"])).alias("path"), c["v"].alias("v")))))
        levels.append(level)
    typed = lambda v: (text(v, "@type") == "PostalAddress") | F.exists(as_list(v, "@type"), lambda t: F.try_variant_get(t, "$", "string") == "PostalAddress")
    plain = lambda v: F.trim(F.coalesce(text(v, "address"), F.lit("")))
    every = F.filter(F.concat(*levels), lambda x: F.coalesce(typed(x["v"]), F.lit(False)) | (F.length(plain(x["v"])) >= 8))
    own = F.transform(every, lambda x: F.struct(x["path"].alias("path"), F.when(F.coalesce(typed(x["v"]), F.lit(False)), one_line(x["v"])).otherwise("").alias("line")))
    loose = F.transform(every, lambda x: F.struct(F.concat(x["path"], F.array(F.lit(-2))).alias("path"), F.when(F.length(plain(x["v"])) >= 8, plain(x["v"])).otherwise("").alias("line")))
    hits = F.concat(own, loose)
    rows = _blocks(pages, ident, html).select(ident, "block", F.inline(hits)).where("line <> ''")
    return rows.groupBy(ident).agg(F.min_by("line", F.struct("block", "path")).alias("address"))
