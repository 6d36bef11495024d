"""URL functions as column expressions. Bad or null URLs give empty parts, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that track a visit and do not name a page.
TRACKING = ("srsltid", "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "yclid", "mc_eid", "igshid", "_ga", "ref", "ref_src", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
# Public suffixes of two labels that the engine knows; any other last label is a suffix by itself.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "co.za", "com.br", "com.mx", "com.tr", "com.sg", "com.hk")

_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def host(url: Column) -> Column:
    """Host in lower case without user, port and www."""
    return F.regexp_replace(F.regexp_replace(F.lower(netloc(url)), r"^.*@|:[0-9]+$", ""), r"^www\.", "")


def registered_domain(url: Column) -> Column:
    """The label before the public suffix, with the suffix; a host of one label is itself."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.least(n, F.lit(2))), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.least(n, F.lit(3))), ".")
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters (in any case) and fragment; other parameters stay as they are written."""
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)), "&")
    base = F.concat(scheme(url), F.lit("://"), netloc(url), path(url))
    return F.when(scheme(url) == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no www, query or fragment, lower-case path without a slash at its end."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.regexp_replace(F.lower(path(url)), r"/+$", ""))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_tokens(url: Column) -> Column:
    """Lower-case path segments, whole and cut at hyphens."""
    segs = F.transform(segments(url), lambda s: F.lower(s))
    return F.array_distinct(F.concat(segs, F.flatten(F.transform(segs, lambda s: F.filter(F.split(s, "-"), lambda t: t != "")))))


def depth(url: Column) -> Column:
    return F.greatest(F.size(segments(url)) - 1, F.lit(0))


def without_dots(path: Column) -> Column:
    """A path (with what follows it) whose . and .. segments are worked out."""
    bare, rest = F.regexp_extract(path, "^([^?#]*)", 1), F.regexp_extract(path, "^[^?#]*(.*)$", 1)
    parts = F.split(bare, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    done = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")
    closed = F.when(bare.rlike("/[.]{1,2}$"), F.concat(done, F.lit("/"))).otherwise(done)
    return F.when(F.contains(bare, F.lit("/.")), F.concat(closed, rest)).otherwise(path)
