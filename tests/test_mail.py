"""Each collector on a page of its own, the order worked out by hand, and odd pages."""

import base64

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import mail

XOR = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "cf@pier.org")
PAGES = {
    "cf_email": f'<i data-cfemail="{XOR}">x</i>', "mailto": '<a class=x href="mailto:Cf@pier.org?subject=hi">write</a>', "mailto_inline": "<b onclick='go(\"mailto:cf@pier.org\")'>x</b>",
    "json_ld": '<script type="application/ld+json">{"@graph": [{"contactPoint": {"email": "cf\\u0040pier.org"}}]}</script>', "json_script": '<script>var a = {contactEmail: "cf@pier.org"};</script>',
    "meta_tag": '<meta property="business:email" content=" cf@pier.org ">', "attr:data-who": '<i data-who="cf@pier.org,">x</i>', "obfuscated": "<p>cf [at] pier [dot] org</p>",
    "base64": f'<script>var contact "{base64.b64encode(b"write cf@pier.org").decode()}"; email "{base64.b64encode(b"to: cf@pier.org now").decode()}"</script>',
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, v, 1) for k, v in PAGES.items()] + [("none", None, 1), ("empty", "", 1), ("bad json", '<script type="application/ld+json">{"email": "a"b@c.org"</script>', 1)]
    return {r.page: (r.address, r.source, r.base) for r in mail.collected(spark.createDataFrame(rows, "page string, html string, base int").select("page", "html"), "page", "html").collect()}


@pytest.mark.parametrize("source", list(PAGES))
def test_each_collector(found, source):
    got = found.get(source)
    assert got and got[0] == "cf@pier.org"
    # an address written plainly is also found as one that is written out
    plain = {"mailto_inline": "mailto_inline", "attr:data-who": "attr:data-who"}.get(source, source)
    assert (got[1], got[2]) == (plain, mail.TRUST[source.split(":")[0]])


def test_nothing_on_odd_pages(found):
    assert "none" not in found and "empty" not in found


def test_sources_in_text(spark):
    html = "<p>&#64;, mail a.b&#x40;pier&#46;org, x..y@pier.org, look@you.there, z@mailinator.com, logo@2x.png</p><!-- c@pier.org --><script>s = 'd@pier.org';</script>"
    finds = spark.createDataFrame([(1, html)], "page int, html string").select(F.inline(mail.finds(F.col("html")))).collect()
    by = {}
    for r in finds:
        by.setdefault(r.address, set()).add(r.source)
    assert by["a.b@pier.org"] == {"visible_text", "obfuscated", "rot13", "raw_html", "html_comment"} and by["c@pier.org"] == {"obfuscated", "rot13", "raw_html", "html_comment"} and by["d@pier.org"] == {"obfuscated", "rot13", "raw_html", "html_comment"}
    got = mail.collected(spark.createDataFrame([(1, html)], "page int, html string"), "page", "html").collect()
    assert sorted((r.address, r.source, r.base) for r in got) == [("a.b@pier.org", "obfuscated", 72), ("c@pier.org", "obfuscated", 72), ("d@pier.org", "obfuscated", 72)]


def test_the_order_worked_out_by_hand(spark):
    html = '<a href="mailto:info@pier.org">mail</a><p>sales@pier.org bob.smith@pier.org noreply@pier.org x@gone.org y@gmail.com</p>'
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    known = spark.createDataFrame([("pier.org", True), ("gone.org", False), ("pier.org", True)], "domain string, mx_ok boolean")
    ranks = mail.ranked(mail.collected(pages, "page", "html"), "page", F.lit("www.pier.org"), known)
    assert [(r.address, r.score) for r in ranks.orderBy("rank").collect()] == [("info@pier.org", 245), ("sales@pier.org", 227), ("bob.smith@pier.org", 212), ("noreply@pier.org", 117), ("y@gmail.com", 92)]
    assert mail.all_addresses(ranks, "page", 3).first().addresses == ["info@pier.org", "sales@pier.org", "bob.smith@pier.org"]
    assert mail.best(ranks, "page").first().address == "info@pier.org"


def test_last_resort_and_ties(spark):
    pages = spark.createDataFrame([(1, "<p>b@other.org a@else.org</p>"), (2, "<p>b@other.org a@else.org c@gmail.com</p>")], "page int, html string")
    ranks = mail.ranked(mail.collected(pages, "page", "html"), "page", F.lit("pier.org"))
    assert {r.page: r.addresses for r in mail.all_addresses(ranks, "page").collect()} == {1: ["b@other.org"], 2: ["c@gmail.com"]}
    assert {r.page: r.address for r in mail.best(ranks, "page", 500).collect()} == {1: "b@other.org", 2: "c@gmail.com"}
    free = mail.ranked(mail.collected(pages, "page", "html"), "page", F.lit(""))
    assert {r.page: r.addresses for r in mail.all_addresses(free, "page").collect()}[1] == ["b@other.org", "a@else.org"]
