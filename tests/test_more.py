"""Providers, page structure and scores on literals."""

from pyspark.sql import functions as F

from corpusloom.operators import pages, scoring
from corpusloom.sources import providers as P


def test_forgiving_json(spark):
    df = spark.createDataFrame([('{"result_limit": 900, "intent": "x"}',), ('Sure! {"intent": "y"} bye',), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(P.parse_plan(F.col("t"))).collect()]
    assert [(g.intent, g.result_limit) if g else None for g in got] == [("x", 100), ("y", 5), None, None]


def test_routes_keep_candidates_only(spark):
    answers = spark.createDataFrame([("s", '{"selected": [{"url": "b", "reason": "r"}, {"url": "zz"}, {"url": "a"}, {"url": "b"}]}')], "site string, t string")
    known = spark.createDataFrame([("s", "a"), ("s", "b")], "site string, url string")
    got = P.chosen_routes(answers, known, "site", "t").orderBy("priority").collect()
    assert [(r.url, r.priority) for r in got] == [("b", 1), ("a", 2)]


def test_embedder(spark):
    got = P.HashEmbedder(16).embed(spark.createDataFrame([("a b c",), ("",), (None,)], "t string"), "t").collect()
    assert abs(sum(x * x for x in got[0].embedding) - 1) < 1e-9 and set(got[1].embedding) == {0.0} and len(got[2].embedding) == 16


def test_verdicts_and_mail(spark):
    rows = spark.createDataFrame([("a", None), ("b", "match"), ("c", "unknown")], "domain string, relevance_category string")
    assert [r.is_lead for r in P.GivenVerdicts().verdict(rows, "x").orderBy("domain").collect()] == [True, True, False]
    known = spark.createDataFrame([("a", True)], "domain string, mx_ok boolean")
    assert [r.mx_ok for r in P.TableMailLookup(known).deliverable(rows, "domain").orderBy("domain").collect()] == [True, None, None]


def test_page_structure():
    got = pages.read_page('<html lang="en"><head><title> A  b </title><meta name="description" content="D"><link rel="canonical" href="/c"></head><body><nav><a href="/x">Go <b>on</b></a></nav><h1>H</h1><h2>I</h2><p>one two<p>one two<script>no()</script><script type="application/ld+json">[{"@type":"Person","name":"Ann Example","jobTitle":"CTO"},{"@graph":[{"@type":["Organization"],"name":"Org"}]}]</script></body></html>')
    assert (got["title"], got["description"], got["canonical"], got["lang"], got["h1"], got["h2s"]) == ("A b", "D", "/c", "en", "H", ["I"])
    assert got["links"] == [{"href": "/x", "anchor": "Go on", "section": "nav"}]
    assert got["lines"] == ["Go on", "H", "I", "one two"] and got["organisation"] == "Org" and got["people"] == [{"name": "Ann Example", "role": "CTO"}]
    assert pages.read_page(None)["lines"] == []


def test_scores(spark):
    df = spark.createDataFrame([("https://a.example/client-portal/about", "x"), ("https://a.example/", "Ã©t")], "url string, t string")
    rows = df.select(scoring.score_url(F.col("url")).alias("s"), scoring.page_name(F.col("url")).alias("n"), scoring.fix_mojibake(F.col("t")).alias("t"), scoring.resolve(F.col("url"), F.lit("../b")).alias("r")).collect()
    assert [(r.s, r.n, r.t, r.r) for r in rows] == [(149, "about", "x", "https://a.example/b"), (0, "home", "ét", "https://a.example/b")]
