"""The element table against a tree built by the XML parser, and broken pages."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dom

TAGS = ["div", "nav", "header", "footer", "main", "aside", "section", "article", "span", "a", "h2", "h3", "a", "a"]


def tree(rng, depth=0):
    tag = rng.choice(TAGS) if depth else "body"
    e = ET.Element(tag)
    if rng.random() < 0.2:
        e.set(*rng.choice([("id", "site-footer"), ("class", "topbar x"), ("class", "Main-Menu"), ("role", "Banner"), ("role", "x"), ("id", "canvas")]))
    if tag == "a" and rng.random() < 0.9:
        e.set("href", f"/{rng.randint(0, 99)}")
    e.text = rng.choice(["t", "word ", ""])
    if tag not in ("a", "h2", "h3") and depth < 5:
        e.extend(tree(rng, depth + 1) for _ in range(rng.randint(0, 4)))
    return e


def by_hand(root):
    """(href, section, location, heading, inside a nav) of each link by walks over ancestors."""
    parent = {c: p for p in root.iter() for c in p}
    ups = lambda e: [] if e not in parent else [parent[e], *ups(parent[e])]
    section = lambda e: next((s for p in ups(e) if (s := dom.section_of(p.tag, dict(p.attrib)))), "body")
    location = lambda e: next((dom.LOCATIONS[p.tag] for p in ups(e) if p.tag in dom.LOCATIONS), "body")
    out, head = [], None
    for e in root.iter():
        text = " ".join("".join(e.itertext()).split())
        if e.tag in dom.HEADINGS and text:
            head = (text, section(e))
        if e.tag == "a" and "href" in e.attrib:
            out.append((e.attrib["href"], section(e), location(e), head[0] if head and head[1] == section(e) else None, any(p.tag == "nav" for p in ups(e))))
    return out


@pytest.mark.parametrize("part", [3, 1 << 16])
def test_links_against_a_tree(spark, part):
    rng = random.Random(8)
    roots = [tree(rng) for _ in range(60)]
    df = spark.createDataFrame([(k, ET.tostring(r, encoding="unicode", short_empty_elements=False)) for k, r in enumerate(roots)], "page_id int, html string").repartition(2)
    rows = dom.elements(df, "page_id", "html")
    got = dom.headed_links(rows, "page_id", part)
    inside = dom.within(rows, "page_id", F.col("tag") == "nav", part).where("tag = 'a' AND href IS NOT NULL").select("page_id", "pre", "inside")
    found = {}
    for r in got.join(inside, ["page_id", "pre"]).orderBy("page_id", "pre").collect():
        found.setdefault(r.page_id, []).append((r.href, r.section, r.location, r.heading, r.inside))
    assert found == {k: x for k, r in enumerate(roots) if (x := by_hand(r))}
    spans = rows.select("page_id", "pre", "post").collect()
    assert len({(r.page_id, t) for r in spans for t in (r.pre, r.post)}) == 2 * len(spans) == 2 * sum(1 for r in roots for _ in r.iter())


def test_broken_pages(spark):
    html = '<p>one<p>two <b>x<ul><li><a href=/a>A <i>b</i></a><li>c</ul></div><img src=x><br/><a name=n>no</a><h2></h2><h2>H &amp; I</h2><a href=" /z ">z'
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (None, "<h1>T</h1><a href='q'>w</a>"), (4, "<script>var a='<a href=b>';</script><!-- <a href=c> -->")], "page_id int, html string")
    rows = dom.elements(df, "page_id", "html")
    tags = {k: [r.tag for r in rows.where(F.col("page_id") == k).orderBy("pre").collect()] for k in (1, 2, 3, 4)}
    assert tags == {1: ["p", "p", "b", "ul", "li", "a", "i", "li", "img", "br", "a", "h2", "h2", "a"], 2: [], 3: [], 4: ["script"]}
    got = [(r.page_id, r.href, r.text, r.heading) for r in dom.headed_links(rows, "page_id").orderBy("page_id", "pre").collect()]
    assert got == [(None, "q", "w", "T"), (1, "/a", "A b", None), (1, "/z", "z", "H & I")]
