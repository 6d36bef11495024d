"""Traps of the functions, on literals."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import rules as R
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import contacts, etl, links, organisation, retrieval, scoring
from corpusloom.sources import tables
from corpusloom.streaming import events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://WWW.Site.example/a/b?UTM_source=x&id=3&Ref=q#top", "https://WWW.Site.example/a/b?id=3"),
        ("https://site.example/?gclid=1", "https://site.example/"),
        ("no url", "no url"),
        (None, ""),
    ],
)
def test_strip_tracking(spark, url, want):
    assert one(spark, U.strip_tracking(F.col("u")), u=url) == want


def test_hosts(spark):
    assert one(spark, U.host(F.col("u")), u="http://me:pw@www.Shop.Example.org:8080/x") == "shop.example.org"
    assert one(spark, U.registered_domain(F.col("u")), u="https://help.shop.co.uk/") == "shop.co.uk"
    assert one(spark, U.normalize(F.col("u")), u="HTTPS://www.A.example/B/?x=1") == "https://a.example/b"


def test_utility_needs_a_dot_and_takes_the_first_label(spark):
    assert one(spark, R.is_utility(F.col("u")), u="https://shop.example/") is True  # an apex host counts, as documented
    assert one(spark, R.is_utility(F.col("u")), u="https://shop/") is False
    assert one(spark, R.is_utility(F.col("u")), u="https://good.example/Privacy") is True


def test_classify_order(spark):
    title = F.lit("10 best harbours")
    got = [one(spark, R.classify_result(F.col("u"), title), u=u) for u in ("https://x.com/a", "https://a.example/forum/best", "https://a.example/", "https://www.yelp.com/a", "")]
    assert got == ["noise", "noise", "discovery_source", "discovery_source", "noise"]


def test_page_types(spark):
    got = [one(spark, R.page_type(F.col("u")), u=f"https://a.example{p}") for p in ("/", "/blog", "/blog/my-post", "/about-us", "/zzz")]
    assert got == ["home", "blog", "blog_post", "about", "other"]


@pytest.mark.parametrize(("text", "want"), [("we have no app here", True), ("our app is coming soon", True), ("get the app today", False), ("happy appetite", None), (None, None), ("no " + "x" * 60 + " app", False)])
def test_negation(spark, text, want):
    assert one(spark, T.negated(F.col("t"), "app"), t=text) is want


def test_csv_safe_and_keys(spark):
    assert [one(spark, T.csv_safe(F.col("t")), t=t) for t in ("=1", "+1", "-1", "@x", "a=1", "")] == ["'=1", "'+1", "'-1", "'@x", "a=1", ""]
    assert one(spark, T.stem(F.col("t")), t="booking") == "book"
    assert one(spark, T.stem(F.col("t")), t="bed") == "bed"


def test_addresses(spark):
    docs = spark.createDataFrame([(1, "Info [at] boats [dot] example, info@boats.example; noreply@other.example a..b@x.example"), (2, None)], "id int, t string")
    got = contacts.ranked(contacts.addresses(docs, "id", "t"), "id", F.lit("boats.example")).collect()
    assert [(r.address, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [("info@boats.example", 130), ("noreply@other.example", -70)]
    code = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "a@b.example")
    assert one(spark, contacts.decode_xor(F.col("c")), c=code) == "a@b.example"
    assert one(spark, contacts.decode_xor(F.col("c")), c="zz") is None


def test_dedupe_first_wins_ties(spark):
    rows = spark.createDataFrame([(1, "k", 5), (2, "k", 9), (3, "k", 9)], "ord int, key string, n int")
    assert [r.ord for r in etl.dedupe_pages(rows, ["key"], F.col("n")).collect()] == [2]


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "a string")
    assert [tuple(r) for r in etl.profile(empty, ["a"]).collect()] == [(0, "a", 0, 0.0)]


def test_scope(spark):
    rows, none = spark.range(3), spark.range(0)
    assert etl.scope(rows, none, "id").count() == 3
    assert etl.scope(rows, spark.range(1), "id").count() == 1


def test_consecutive_lines(spark):
    docs = spark.createDataFrame([(1, "a\n\n a \nb\na"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.lines for r in links.consecutive_lines(docs, "id", "t").collect()}
    assert got[1] == ["a", "b", "a"] and got[3] == [] and not got[2]


def test_department_order(spark):
    got = [one(spark, organisation.department(F.col("r")), r=r) for r in ("Sales Director", "CTO", "Art Director", "Plant Manager", "Poet", None)]
    assert got == ["Sales", "Technology", "Executive", "Operations", None, None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n?!;", max_size=900))
def test_chunks_lose_no_letter_and_keep_bounds(text):
    chunks = retrieval.chunk_text(text)
    assert all(0 < len(c) <= retrieval.SIZE + retrieval.OVERLAP + 1 for c in chunks)
    joined = "".join(chunks)
    assert all(joined.count(c) >= text.count(c) for c in "ab")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=30))
def test_merged_pieces_keep_order(lengths):
    pieces = [chr(97 + k % 26) * min(n, retrieval.SIZE) for k, n in enumerate(lengths)]
    seen = " ".join(retrieval.merge_pieces(pieces)).split(" ") if pieces else []
    place = 0
    for p in pieces:
        place = seen.index(p, place)


def test_noisy_or(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([2.0, -1.0],), ([],)], "w array<double>")
    assert [r[0] for r in df.select(retrieval.noisy_or(F.col("w"))).collect()] == [0.75, 1.0, 0.0]


def test_upsert_leaves_no_stale_rows(spark):
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "url string, n int")
    new = spark.createDataFrame([("a", 7)], "url string, n int")
    assert sorted(tuple(r) for r in retrieval.upsert(old, new, "url").collect()) == [("a", 7), ("b", 0)]


def test_routes(spark):
    rows = spark.createDataFrame([(200, "http", "x" * 500, 0), (200, "http", "x", 0), (503, "http", "", 1), (503, "http", "", 3), (500, "browser", "", 3), (None, "http", "", 0)], "status_code int, method string, html string, attempt int")
    assert [r.route for r in events.route(rows).collect()] == ["parse", "render", "retry", "render", "failed", "retry"]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.select("event_id", "user_id", "event_type", "ts", "value").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in"))
    q = stream.groupBy("event_type").count().writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in batch.groupBy("event_type").count().collect()}
    assert {tuple(r) for r in spark.table("counted").collect()} == want


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "index.csv").write_text('domain,page_url,other\na.example,"https://a.example/x",1\n')
    got = tables.read_index(spark, f"{tmp_path}/index.csv").first()
    assert got.domain == "a.example" and got.email == "" and "other" not in got.asDict()
    (tmp_path / "docs.csv").write_text('page_url,page_title,page_text\nu,t,"two\nlines"\nv,w,\n')
    assert [tuple(r) for r in tables.read_source_docs(spark, f"{tmp_path}/docs.csv").collect()] == [("u", "t", "two\nlines")]
    tables.write_export(spark.createDataFrame([("=1+1",)], "a string"), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").first()[0] == "'=1+1"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "domain string, n int")
    tables.write_domains(rows, f"{tmp_path}/t")
    tables.write_domains(rows.where("domain = 'a'").withColumn("n", F.lit(9)), f"{tmp_path}/t")
    assert sorted((r.domain, r.n) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 9), ("b", 2)]
    spark.dataSource.register(tables.PagedSearch)
    assert spark.read.format("paged_search").option("query", "x").load().count() == 0


def test_without_the_llm_subpackage():
    import subprocess
    import sys

    code = "import sys\nclass Gone:\n    def find_spec(self, name, *a):\n        if name == 'corpus_pipeline' or name.startswith('corpusloom.llm'):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_tech_rules_cover_every_indicator(spark):
    found = {
        "Salesforce": "lightning.force", "HubSpot": "HSForms", "Zoho": "zohopublic", "Microsoft Dynamics": "Dynamics 365", "Pipedrive": "pipedrive", "Freshworks": "freshdesk", "Bitrix24": "bitrix24",
        "Login/Sign-in page": "Sign\tin", "My Account": "my-account", "Client Portal": "client portal", "Dashboard": "dashboard", "Member Area": "member-area",
        "Stripe": "js.stripe.com", "PayPal": "paypalobjects", "Square": "square.site", "Authorize.net": "authorize.net", "Checkout": "checkout", "Cart": "shoppingcart", "Buy Now": "BuyNow",
        "Intercom": "widget.intercom", "Drift": "js.driftt.com", "Crisp": "crisp.chat", "Zendesk": "zdassets", "Tawk.to": "tawk.to", "LiveChat": "livechatinc",
        "Google Analytics": "gtag(", "GA4": "G-AB12CD3", "Google Tag Manager": "googletagmanager.com", "Mixpanel": "mixpanel.com", "Hotjar": "hotjar.com", "Segment": "cdn.segment", "Meta Pixel": "fbq(",
        "OAuth": "oauth", "Auth0": "auth0.com", "Okta": "okta.com", "Clerk": "clerk.dev", "Firebase Auth": "firebaseapp.com",
    }
    generic = {"Login/Sign-in page", "My Account", "Client Portal", "Dashboard", "Member Area", "Checkout", "Cart", "Buy Now", "OAuth"}
    rows = [*((f"<p>{t}</p>",) for t in found.values()), ("track(12) my_account \u00e9cart clients portal",), (None,)]
    got = organisation.detections(spark.createDataFrame(rows, "html string").withColumn("k", F.monotonically_increasing_id()), "k", "html").collect()
    assert {(r.technology, r.confidence) for r in got} == {(t, 55 if t in generic else 85) for t in found} and len(got) == len(found) == 37


def test_non_english(spark):
    portuguese = "o barco que para em um porto com uma vela e os remos que não são para as ondas de verão"
    mixed = " ".join(["il la der die und el los le des est"] + ["alpha"] * 20)
    cases = [(portuguese, "", True), (portuguese, "en-GB", False), ("short", "pt", True), ("short", "eng", True), ("short", "", False), (mixed, "", False), ("the and of to is " * 9, None, False), (None, None, False), ("für mit nicht wir über " * 5, "", True)]
    got = spark.createDataFrame(cases, "t string, lang string, want boolean").select("want", scoring.is_non_english(F.col("lang"), F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_edges_of_all_kinds_of_links(spark):
    html = """<a href="/y"><span>Contact</span> <b>us</b></a> <a class=x href=/z>z</a><A HREF='//o.example/p?q'>o</A> <a href="open">never ended <a href=" rel/./a ">r</a><a name=n>no</a><a href="#top">t</a><a href="mailto:a@b.c">m</a>"""
    df = spark.createDataFrame([(1, "https://www.s.example/d/e", html), (2, "https://s.example", None)], "page_id int, url string, html string")
    got = [(r.dst, r.anchor) for r in links.edges(df).orderBy("pos").collect()]
    assert got == [("https://s.example/y", "Contact us"), ("https://s.example/z", "z"), ("https://o.example/p", "o"), ("https://s.example/d/open", "never ended"), ("https://s.example/d/rel/a", "r")]
