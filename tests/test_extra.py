"""Literal cases of people, contacts, names, links, hybrid ranking, staging and stream stages, with results stated by hand."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import contacts, hybrid, links, organisation, people, retrieval, scoring
from corpusloom.sources import tables
from corpusloom.streaming import events as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_are_probed(spark):
    rows = [(k, "h", n) for k, n in enumerate(["a", "a", "a-2", "a", "b", "b", "a-2", "c-2", "c"])] + [(20, "g", "a"), (21, "g", "a-2")]
    df = spark.createDataFrame(rows, "page_id long, host string, name string")
    got = {r.page_id: r.unique_name for r in scoring.unique_names(df, "host", "name", "page_id").collect()}
    assert got == {0: "a", 1: "a-2", 2: "a-2-2", 3: "a-3", 4: "b", 5: "b-2", 6: "a-2-3", 7: "c-2", 8: "c", 20: "a", 21: "a-2"}


def test_people_lines(spark):
    text = "Our team\nJane O'Neil\nChief Marketing Officer\n\n- Bob Stone | Head of Sales\nHuman Resources, Director\nJane O'Neil, CEO\nlower case\nCTO\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "page_id long, text string")
    got = [(r.name, r.role, r.confidence) for r in people.named(df, "page_id", "text").orderBy("pos").collect()]
    assert got == [("Jane O'Neil", "Chief Marketing Officer", 0.78), ("Bob Stone", "Head of Sales", 0.9)]


@pytest.mark.parametrize(("raw", "country", "want"), [("+1 (212) 555-0199", "", "+12125550199"), ("(089) 1234567", "de", "+49891234567"), ("212206612192", "", ""), ("+12", "", "+12"), (None, "US", ""), ("212 555 0199", "us", "+12125550199")])
def test_phones(spark, raw, country, want):
    assert one(spark, contacts.format_phone(F.lit(raw), F.lit(country))) == want


def test_addresses_and_codes(spark):
    assert one(spark, contacts.address_of(F.lit("see 5 Elm St\nor 12 Main Street, New York, NY 10065 today"))) == "12 Main Street, New York, NY 10065"
    assert one(spark, contacts.address_of(F.lit("none"))) == ""
    assert one(spark, contacts.decode_base64(F.lit("YW5uQHgudGVzdA"))) == "ann@x.test"
    assert one(spark, contacts.decode_base64(F.lit("not base64!"))) is None and one(spark, contacts.decode_base64(F.lit("AAAAAAAA"))) is None
    assert one(spark, contacts.decode_entities(F.lit("a&#064;b&#x2E;c &amp;"))) == "a@b.c &amp;"
    for address, good in (("a@b.co", True), ("..@b.co", False), ("a@b", False), ("noreply@b.co", False), ("a@b..co", False), ("a@b.c0", False), ("me@domain.com", False)):
        assert one(spark, contacts.is_valid_strict(F.lit(address))) is good


def test_a_house_number_is_no_postal_code(spark):
    assert one(spark, contacts.address_of(F.lit("at\n10000 Mill Lane"))) == "10000 Mill Lane"
    assert one(spark, contacts.address_of(F.lit("10000 Mill Lane\n7 Elm Street, Port 10065 today"))) == "7 Elm Street, Port 10065"
    assert one(spark, contacts.address_of(F.lit("10000 Mill Lane, Port 20002-1234 now"))) == "10000 Mill Lane, Port 20002-1234"
    assert one(spark, contacts.address_of(F.lit("at 1234567 Mill Lane"))) == "1234567 Mill Lane"


def test_real_suffixes(spark):
    found = spark.createDataFrame([("a.co.uk",), ("b.there",), ("com",), ("x.y.com",)], "domain string")
    suffixes = spark.createDataFrame([("com",), ("co.uk",), ("uk",)], "suffix string")
    assert sorted(r.domain for r in contacts.with_real_suffix(found, "domain", suffixes).collect()) == ["a.co.uk", "x.y.com"]


def test_surest_technology_wins(spark):
    df = spark.createDataFrame([("h", "add to cart, pay by paypal.com"), ("g", "checkout cart"), ("e", None)], "host string, html string")
    got = {r.host: (r.technology, r.confidence) for r in organisation.capabilities(organisation.detections(df, "host", "html"), "host").where("category = 'payments'").collect()}
    assert got == {"h": ("PayPal", 85), "g": ("Checkout", 55)}


def test_relative_links(spark):
    html = """<a href='about'>A</a><a class="x" href="../up/./b?q=1">B</a><a href="//o.example/z">C</a><a href="#top">D</a><a href="mailto:a@b.c">E</a><A HREF="HTTPS://W.example/Q">F</A>"""
    df = spark.createDataFrame([(1, "https://h.example/dir/sub/page", html)], "page_id long, url string, html string")
    assert [(r.dst, r.anchor) for r in links.edges(df).orderBy("pos").collect()] == [("https://h.example/dir/sub/about", "A"), ("https://h.example/dir/up/b", "B"), ("https://o.example/z", "C"), ("https://w.example/q", "F")]
    for path, want in (("/a/../b", "/b"), ("/../a", "/a"), ("/a/./", "/a/"), ("/a/..", "/"), ("/a?x=/../b", "/a?x=/../b")):
        assert one(spark, U.without_dots(F.lit(path))) == want


def test_junk_filter_is_data(spark):
    from dataclasses import replace

    mine = replace(scoring.JunkFilter(), tokens=("shop",))
    for url, plain, own in (("https://a.example.com/blog", True, False), ("https://a.example.com/shop", False, True), ("https://a.example.com/x.avif", True, True), ("https://t.me/x", True, True)):
        site = F.lit("t.me" if "t.me" in url else "example.com")
        assert (one(spark, scoring.is_junk(F.lit(url), site)), one(spark, scoring.is_junk(F.lit(url), site, mine))) == (plain, own)


def test_sources_and_consent(spark):
    assert [one(spark, R.source_confidence(F.lit(f"https://{b}.com/"))) for b in ("navily", "yelp", "vitals", "harbour")] == ["high", "medium", "low", None]
    assert one(spark, R.without_consent(F.lit("Our cookies are baked daily\nNecessary  Cookies\nPlease Accept all Cookies now\nend"))) == "Our cookies are baked daily\nend"
    assert one(spark, T.shorten(F.lit("a " * 400), 10)) == "a a a a a…"


def test_best_hits(spark):
    rows = [("a", 0, 0, 0.8), ("a", 1, 1, 0.96), ("a", 2, 2, 0.99), ("b", 0, 0, 0.5), ("c", 0, 1, 0.9), ("c", 0, 2, 0.9)]
    got = {r.company: (r.query, r.ord) for r in people.best_hit(spark.createDataFrame(rows, "company string, query int, ord int, confidence double"), "company", "ord", "confidence").collect()}
    assert got == {"a": (1, 1), "c": (0, 1)}


CORPUS = [
    (1, "We are a gym in Lahore with trainers and weights", "plain"), (2, "Download our app today from the store", "yes"), (3, "There is no app yet, call us instead", "no"),
    (4, "Our mobile app is launching soon", "no"), (5, "Weights and trainers in a gym in Lahore near you, gym gym", "plain"), (6, "Happy applause for appetisers", "plain"),
]


def by_hand(question, dim=4096):
    """The same ranking without hashing: exact cosines of bags of words."""
    q = hybrid.Question.read(question)
    bag = lambda t: {w: t.count(w) for w in t}
    words = {k: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for k, t, _ in CORPUS}
    cos = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    strength = {k: {w: 1.0 if w in ws else 0.9 if retrieval.stem_of(w) in map(retrieval.stem_of, ws) else 0.0 for w in q.words} for k, ws in words.items()}
    df = {w: sum(s[w] > 0 for s in strength.values()) for w in q.words}
    idf = {w: hybrid.idf_of(df[w], len(CORPUS)) for w in q.words}
    f = hybrid.focus(q, idf)
    out = []
    for k, t, _ in CORPUS:
        s = strength[k]
        says_no = {w: s[w] > 0 and retrieval.negated_literal(t, w) for w in q.words}
        opposite = {w: s[w] > 0 and says_no[w] != (w in q.negated) for w in q.words}
        bonus = 1.0
        for w in q.words:
            solo = hybrid.SOLO if w in f.gate else 1.0
            bonus *= 1 - min(1, s[w] * idf[w] * hybrid.saturation_of(df[w], len(CORPUS)) * (hybrid.MISMATCH if opposite[w] else 1) * solo)
        lift = 0.55 * max(0.0, cos(bag(words[k]), bag(list(f.phrase))))
        has = s[f.word] > 0
        if has and opposite[f.word]:
            lift *= hybrid.MISMATCH
        out.append((not has, -(cos(bag(words[k]), bag(question.lower().split())) + 0.5 * (1 - bonus) + lift), k))
    return [k for _, _, k in sorted(out)]


@pytest.mark.parametrize("question", ["gym without app", "which gym has an app"])
def test_hybrid_tiers(spark, question):
    df = spark.createDataFrame(CORPUS, "doc_id long, chunk string, kind string")
    got = hybrid.rank(df, ["doc_id"], "chunk", question, dim=4096).collect()
    assert [r.doc_id for r in got] == by_hand(question)
    assert {r.doc_id for r in got[:3]} == {2, 3, 4} and {r.doc_id: r.evidence for r in got[:3]} == {2: "confirmed_present", 3: "confirmed_absent", 4: "confirmed_absent"}
    assert [r.evidence for r in got[3:]] == ["no_evidence"] * 3
    assert got[0].doc_id == (2 if "has" in question else 3) or got[0].doc_id in (3, 4)


def test_question_chains():
    assert hybrid.chains(hybrid.bigrams("no user login system in new york")) == [["user", "login", "system"], ["new", "york"]]
    q = hybrid.Question.read("driving schools with no physical office in new york")
    f = hybrid.focus(q, {"driving": 0.3, "schools": 0.2, "physical": 0.9, "office": 0.4, "new": 0.1, "york": 0.5})
    assert (f.word, f.phrase, f.partner, f.gate["new"]) == ("physical", ("physical", "office"), "office", "york")


def test_hash_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("one two two",), ("",), (None,)], "t string").select(retrieval.hash_vector(F.col("t"), 512).alias("v"))
    rows = [r.v for r in df.collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-12 and sorted(abs(round(x, 6)) for x in rows[0] if x) == [0.447214, 0.894427] and not any(rows[1]) and not any(rows[2])


def test_staging(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("a", "u1"), ("b", "u2")], "domain string, url string")
    tables.stage_pages(rows, path, "r1")
    tables.stage_pages(rows.where("domain = 'a'"), path, "r2")
    assert tables.staged(spark, path, "r1").count() == 2
    assert tables.discard_staged(spark, path, "r1", "b") and not tables.discard_staged(spark, path, "r9")
    tables.commit_staged(spark, path, "r1")
    assert [(r.domain, r.url) for r in spark.read.parquet(f"{path}/pages").collect()] == [("a", "u1")]
    assert tables.clean_orphans(spark, path, alive=[]) == ["r2"] and tables.clean_orphans(spark, path, alive=[]) == []
    tables.append_rows(spark.createDataFrame([("d.test", 5)], "domain string, other int"), f"{path}/index")
    tables.append_rows(spark.createDataFrame([("e.test",)], "domain string"), f"{path}/index")
    assert sorted(r.domain for r in tables.read_index(spark, f"{path}/index").collect()) == ["d.test", "e.test"]


def test_rounds_stop_when_enough(spark):
    asked = []

    def batch(k):
        asked.append(k)
        return spark.range(10 * k, 10 * k + 10) if k < 5 else None

    out = ST.rounds(batch, lambda df: df.where("id % 2 = 0"), lambda df, k: df, wanted=7)
    assert [df.count() for df in out] == [5, 2] and asked == [0, 1, 2]


def test_stream_parses_and_ends_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("u1", "<p>one two</p>", "done", 1), ("u1", None, "failed", 2), ("u2", "<<<", "started", 3)], "url string, html string, kind string, n int").withColumn("ts", F.timestamp_seconds("n")).write.parquet(src)
    stream = ST.file_stream(spark, src, spark.read.parquet(src))
    out = ST.parse(ST.terminal(stream, "url", "ts")).select("url", "kind", "page.n_words")
    q = out.writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ends").count() == 1 and spark.table("ends").first().url == "u1"
