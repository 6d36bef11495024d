"""Each operator against brute force on small fixtures with nulls, blanks, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, exact_dedup, filters, html_text, jaccard, language_id, lm, packing, quality, quality_rules, substring_dedup
from corpusloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, lang string, source string, __id string, __text string, t int, b int, h string"


def texts(seed: int, n: int = 60) -> list:
    """Random texts with copies, near copies, shared passages, blanks, nulls and one long text."""
    r = random.Random(seed)
    word = lambda: r.choice(("the", "of")) if r.random() < 0.3 else "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(60)]
    out = [" ".join(word() for _ in range(r.randint(1, 120))) for _ in range(n)]
    for k in range(0, n, 5):
        own = out[k].split()
        out.append(" ".join(own))
        if len(own) > 3:
            own[r.randrange(len(own))] = "changed"
            out.append("\n".join(own).upper())
        out.append(f"{out[k]} {' '.join(passage)}\t{word()}")
    out += [None, "", " \t\n ", "one", "One two", "one  TWO", out[0], " ".join(word() for _ in range(5000)), "x" * 5000]
    r.shuffle(out)
    return out


def frame(spark, rows: list):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", 1, 2, "z") for i, t in enumerate(rows)], CLASH)


def words(t, lower=False):
    t = t or ""
    return WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}) if lower else t)


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 64), (2, 8)])
def test_substring_dedup(spark, seed, bits):
    a, b = thue_morse(2048, "ab"), thue_morse(2048, "ba")
    rows = [*texts(seed), " ".join([a] * 20), " ".join([b] * 20)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, rows), carry=["lang", "t"], hash_bits=bits).collect()}
    seen = set()
    for i, t in enumerate(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        assert (got[i].n_words, got[i].n_removed, got[i].text, got[i].lang) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), "en")
        assert sum(x.end - x.start for x in got[i].intervals) == sum(gone)


def test_substring_dedup_cut_keeps_white_space(spark):
    base = " ".join(f"w{k}" for k in range(25))
    rows = [base, f"a\n\nb {base}\n c  d", f"{base}"]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(frame(spark, rows), cut=True).collect()}
    assert got == {0: base, 1: "a\n\nb c  d", 2: ""}


def test_substring_dedup_ties_and_null_ids(spark):
    base = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(1, base), (1, base), (None, base), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(False, 1, 0), (False, 1, 25), (False, 2, 0), (True, 0, 25)]


@pytest.mark.parametrize("f", [substring_dedup.substring_dedup, exact_dedup.exact_dedup, jaccard.jaccard_components, packing.best_fit, language_id.language_id, lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: quality.quality(d, d.select("doc_id", F.lit(1).alias("quality"))), lambda d: quality_rules.quality_rules(d, d.select("doc_id", F.lit(1).alias("quality"))), lambda d: lm.score_texts(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)])
def test_empty_table(spark, f):
    assert f(frame(spark, []).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_exact_dedup(spark, seed):
    rows = texts(seed) + ["a b", "ab", "a  b", "a b"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(rows):
        groups["".join(words(t))].append(i)
    assert len(got) == len(rows)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(rows[i] or ""), i))
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    removed = {r.doc_id for r in exact_dedup.removed_ids(frame(spark, rows)).collect()}
    assert removed == {i for i in got if not got[i].kept}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3), max_size=30), min_size=1, max_size=5))
def test_filters_merge_without_loss(parts):
    Q = exact_dedup.CountingQuotientFilter
    built = [Q.unpack(Q.build(np.array(p, np.uint64)).pack()) for p in parts]
    cut = [f for b in built for _, f in b.ranges(4)]
    merged = Q.merge(cut) if cut else Q.build(np.zeros(0, np.uint64))
    assert dict(zip(merged.fingerprints().tolist(), merged.count.tolist(), strict=True)) == collections.Counter(x for p in parts for x in p)


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def components_by_hand(rows, size, num, den):
    sets = []
    for t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(rows))}


@pytest.mark.parametrize(("seed", "size", "num", "den", "bits"), [(5, 3, 90, 100, 64), (6, 5, 80, 100, 64), (7, 3, 90, 100, 8)])
def test_jaccard(spark, seed, size, num, den, bits):
    rows = texts(seed)
    r = random.Random(seed)
    base = [f"v{r.randrange(999)}" for _ in range(150)]
    for _ in range(40):  # a cloud of near copies around one text, some just apart
        own = list(base)
        for _ in range(r.randrange(5)):
            own[r.randrange(len(own))] = f"u{r.randrange(99)}"
        rows.append(" ".join(own))
    rows += ["a b c a b", "b c a b c", thue_morse(2048, "ab"), thue_morse(2048, "ba")]  # equal sets of unequal sequences; words that polynomials confuse
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(frame(spark, rows), words=size, num=num, den=den, hash_bits=bits).collect()}
    assert got == components_by_hand(rows, size, num, den)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=30), st.text("ab ", max_size=30)), min_size=1, max_size=4), st.sampled_from([1, 64]), st.sampled_from([1, 3, 5]))
def test_compare_counts_common_shingles(pairs, bits, size):
    def sets(t):
        w = t.split()
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    common_, union = jaccard.compare([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], size, bits)
    assert list(zip(common_, union, strict=True)) == [(len(sets(a) & sets(b)), len(sets(a) | sets(b))) for a, b in pairs]


def test_a_cloud_apart_from_its_leader(spark):
    """A third of all rows share most segments; the least of them links to none of the others, which link among themselves."""
    r = random.Random(21)
    base = [f"v{k}" for k in range(200)]
    rows = [" ".join([*base[:150], *(f"z{k}" for k in range(50))])]
    for k in range(60):
        own = list(base)
        own[r.randrange(200)] = f"u{k}"
        rows.append(" ".join(own))
    rows += [" ".join(f"o{k}x{j}" for j in range(60)) for k in range(120)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == components_by_hand(rows, 3, 90, 100) and len({c for _, c in got.values()}) == 122


@settings(max_examples=200, deadline=None)
@given(st.integers(20, 400), st.integers(0, 40), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]))
def test_linked_sets_share_a_signature(size, change, seed, sim):
    r = np.random.default_rng(seed)
    t = jaccard.Threshold(*sim)
    a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
    drop = r.permutation(len(a))[: min(change, len(a) - 1)]
    b = np.unique(np.concatenate((np.delete(a, drop), r.integers(0, 2**63, change // 2).astype(np.uint64))))
    common_ = len(np.intersect1d(a, b))
    if t.den * common_ < t.num * (len(a) + len(b) - common_):
        return
    ends = t.bands(1 << 20)
    band = max(int(np.searchsorted(ends, len(x), side="right")) - 1 for x in (a, b))
    h = t.differences(2 * (ends[band + 1] - 1))
    for alloc in (jaccard.allocate(h, len(a), 10), jaccard.allocate(h, len(a), 10**9), jaccard.Allocation(h + 1, 0, 0), jaccard.Allocation((h + 5) % 2, (h + 5) // 2, 4)):
        assert np.intersect1d(jaccard.signatures(a, band, alloc), jaccard.signatures(b, band, alloc)).size


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_without_ids(spark):
    docs = spark.createDataFrame([(k, "x") for k in range(50)] + [(None, "n")], "doc_id long, text string")
    out = filters.without_ids(docs, spark.createDataFrame([(3,), (4,), (3,), (None,)], "x long"), "doc_id")
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [k for k in range(50) if k not in (3, 4)]
    assert out.where("doc_id IS NULL").count() == 1


def test_packing_is_best_fit(spark):
    r = random.Random(9)
    docs = [(k, " ".join(f"q{r.randrange(9999)}" for _ in range(r.choice((0, 1, 5, 20, 33, 70)))), r.choice((None, "a", "b", "c"))) for k in range(150)]
    docs += [(500 + k, docs[k][1], docs[k][2]) for k in range(10)]
    got = packing.best_fit(spark.createDataFrame(docs, "doc_id long, text string, source string"), capacity=32, shard=10**6).collect()
    bins: list[dict] = []
    want = {}
    order = [(row, k, n) for row, k, n in packing.pieces([len(words(t)) for _, t, _ in sorted(docs)], 32)]
    rows = sorted(docs)
    for row, k, n in order:
        i, t, s = rows[row]
        c = "".join(words(t, lower=True))
        fit = [b for b in bins if b["free"] >= n and c not in b["clusters"] and (s is None or s not in b["sources"])]
        if fit:
            tight = min(b["free"] for b in fit)
            b = min((b for b in fit if b["free"] == tight), key=lambda b: b["since"])
        else:
            b = {"id": len(bins), "free": 32, "clusters": set(), "sources": set()}
            bins.append(b)
        want[i, k] = (b["id"], 32 - b["free"], n)
        b["free"] -= n
        b["since"] = len(want)
        b["clusters"].add(c)
        b["sources"] |= {s} - {None}
    assert {(r.doc_id, r.piece): (r.bin, r.bin_offset, r.n_words) for r in got} == want


def test_packing_cuts_long_documents(spark):
    got = packing.best_fit(frame(spark, [" ".join(["w"] * 70), None]), capacity=32).orderBy("doc_id", "piece").collect()
    assert [(r.doc_id, r.piece, r.n_words) for r in got] == [(0, 0, 32), (0, 1, 32), (0, 2, 6), (1, 0, 0)]
    assert len({r.bin for r in got if r.doc_id == 0}) == 3


def test_bpe_round_trip_and_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*texts(10), "a<|endoftext|>b <|endoftext|>", "I'll  don't\n\n　漢字 🎉", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "\x00\x7f"]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, rows), path), path).collect()}
    t = Tokenizer.from_file(path)
    for i, x in enumerate(rows):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].text == t.decode(ids, skip_special_tokens=False) == (x or "")
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([10**6]), bpe.vocabulary(path))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_bpe_matches_library(rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = test_bpe_matches_library.__dict__.setdefault("t", Tokenizer.from_file(path))
    encoder = test_bpe_matches_library.__dict__.setdefault("e", bpe.Encoder(bpe.vocabulary(path), most=50))
    assert [x.tolist() for x in encoder(rows)] == [x.ids for x in t.encode_batch(rows, add_special_tokens=False)]


def test_html():
    page = """<!doctype html><html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><header>Site</header><nav><a href="/">Home</a></nav>
    <div class="ad banner">Buy</div><!-- <p>no</p> --><article><header><h1>Head&amp;line</h1></header><p>First <b>bold</b>&nbsp;text<br>next<p>Second&lt;x&gt; <a href='a>b'>link</a>
    <form>Name <input></form><aside>Side</aside><section class="comments"><p>Nice!</p></section><ul><li>One<li>Two</ul></article><footer>&copy;</footer>"""
    main, opened, out, declared = html_text.scan(page)
    assert declared and main == ["Head&line", "First bold text next", "Second<x> link", "One", "Two"] and opened == []
    assert {"Home", "Buy", "Side", "Nice!", "©"} <= set(out)
    assert html_text.scan("") == ([], [], [], False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_suffix_array(tokens):
    order, lcp = html_text.suffix_array(np.array(tokens, np.int64))
    assert order.tolist() == sorted(range(len(tokens)), key=lambda k: tokens[k:])
    for k in range(1, len(tokens)):
        a, b = tokens[order[k] :], tokens[order[k - 1] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_host_boilerplate(spark):
    line = "please sign up for our weekly letter and never miss a story again"
    pages = [(k, f"https://www.h.example/{k}", f"<body><div>{line}</div><div>own text of page number {k} with words w{k}</div></body>") for k in range(4)]
    pages += [(9, "https://other.example/", f"<body><div>{line}</div></body>"), (10, None, None), (11, "https://h.example/z", "<article><p>" + line + "</p></article>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"own text of page number {k} with words w{k}" for k in range(4)}, 9: line, 10: "", 11: line}


def test_names_beside_other_words_are_prose():
    for html in ("<main><div id='related-work'>kept</div></main>", "<main><section class='social-history'>kept</section></main>", "<div class='post-share-story'>kept</div>"):
        main, opened, out, _ = html_text.scan(html)
        assert main + opened == ["kept"] and out == []
    for name in ("ad", "ad-slot", "siteFooter", "x share-buttons", "comment_list", "related-posts"):
        assert html_text.scan(f"<main><div class='{name}'>gone</div></main>")[0] == []


def by_hand(pages, articles, least=html_text.REPEAT):
    """Texts of one host's pages by comparing all windows of words."""
    seen = collections.defaultdict(lambda: collections.defaultdict(set))
    scanned = []
    for k, html in pages:
        main, opened, out, declared = html_text.scan(html)
        kinds = [("d", x) for x in main] + [("l" if declared else "o", x) for x in opened] + [("l", x) for x in out]
        scanned.append(kinds)
        for kind, block in kinds:
            w = block.split(" ")
            for i in range(len(w) - least + 1):
                seen[tuple(w[i : i + least])][kind].add(k)
    texts_ = {}
    for (k, _), kinds in zip(pages, scanned, strict=True):
        blocks = []
        for kind, block in kinds:
            w = block.split(" ")
            gone = [False] * len(w)
            for i in range(len(w) - least + 1):
                s = seen[tuple(w[i : i + least])]
                if kind == "o" and len(s["o"] | s["l"]) > 1 or articles and kind == "d" and len(s["d"]) > 1 and len(s["l"]) > 1:
                    gone[i : i + least] = [True] * least
            left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
            if kind != "l" and left:
                blocks.append(left)
        texts_[k] = "\n\n".join(blocks)
    return texts_


@pytest.mark.parametrize(("shard", "articles"), [(4, True), (1024, True), (4, False), (1024, False)])
def test_html_against_brute_force(spark, monkeypatch, shard, articles):
    monkeypatch.setattr(html_text, "SHARD", shard)
    r = random.Random(31)
    lines = [" ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.choice((6, 9, 14)))) for _ in range(25)]
    def page(k):
        line = lambda: r.choice(lines) if r.random() < 0.5 else " ".join(f"q{r.randrange(9999)}" for _ in range(10))
        body = "".join(f"<p>{line()} {line()}</p>" for _ in range(3))
        if k % 3 == 0:
            return f"<body><div>{line()}</div>{body}<footer>{line()}</footer></body>"
        return f"<body><nav>{line()}</nav><article>{body}</article><div class='notice'>{line()}</div></body>"

    pages = [(k, page(k)) for k in range(60)]
    want = by_hand(pages, articles)
    rows = [(k, f"https://h.example/{k}", h, "x", 1) for k, h in pages]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, __host int"), thin_articles=articles).collect()}
    assert got == want and articles == any(want[k] != "\n\n".join(html_text.scan(h)[0]) for k, h in pages if k % 3)


def test_html_empty_table(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_id(spark):
    r = random.Random(12)
    speak = {"aa": ("the", "of", "and", "tion"), "bb": ("der", "und", "schl", "ung"), "cc": ("que", "ción", "los", "ñar")}
    rows = [(k, " ".join(r.choice(speak[lang]) + r.choice(speak[lang]) for _ in range(40)), lang) for k in range(120) for lang in [("aa", "bb", "cc")[k % 3]]]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, rows[0][1], None)]
    got = {x.doc_id: x for x in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "aa"
    held = [(got[k].lang_pred, lang) for k, _, lang in rows[:120] if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and all(0 <= x.score <= 1 for x in got.values())


def labelled():
    r = random.Random(13)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(60, 90)))
    docs = [(k, good() if k % 4 else " ".join(w + "###" for w in good().split())) for k in range(400)]
    return docs, [(k, int(k % 4 > 0)) for k in range(300)]


def test_quality_classifier(spark):
    docs, labels = labelled()
    d, lab = spark.createDataFrame([*docs, (999, None)], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality(d, lab).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 401
    assert sum((got[k] >= 0.3) == (k % 4 > 0) for k in range(300, 400)) >= 97


def test_quality_rules(spark):
    docs, labels = labelled()
    rows = texts(14)
    d = spark.createDataFrame([*docs, *[(1000 + k, t) for k, t in enumerate(rows)]], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for i, t in [*docs, *[(1000 + k, t) for k, t in enumerate(rows)]]:
        w = words(t)
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + o for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert x.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not x.base_failed or not x.kept)
    assert all(got[k].kept == (k % 4 > 0) for k in range(400))
    plan = quality_rules.quality_rules(d, spark.createDataFrame(labels, "doc_id long, quality int")).where("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("arrow", "")


def test_lm_base_and_gradients(spark):
    rows = texts(15)
    got = {r.doc_id: r for r in lm.score_texts(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    tokens = [[*words(t, lower=True), None] for t in rows]
    c = collections.Counter(w for i, ws in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(tokens):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].score < 0
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 200)
    m = lm.Model(rng, np.arange(50), np.arange(50) % lm.CLASSES, np.arange(50) % 4, np.zeros((4, 50)))
    m.p = {k: w.astype(np.float64) for k, w in m.p.items()}
    x, real, y, use = lm.cut_windows(ids, np.array([120, 80]), 49)
    assert y[use].tolist() == ids.tolist()  # each id is scored once, in order
    _, g = m.gradients(x, real, y, use)
    for k in m.p:
        at = tuple(rng.integers(0, s) for s in m.p[k].shape) if k != "emb" else (int(ids[3]), 2)
        old = m.p[k][at]
        losses = []
        for e in (1e-4, -1e-4):
            m.p[k][at] = old + e
            losses.append(m.gradients(x, real, y, use)[0])
        m.p[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - g[k][at]) < 1e-3


def test_words_and_windows():
    arr = pa.array(["ab  c", None, "", " d\x0be\x0c", "c"])
    raw, off = common.buffers(arr)
    w = common.Words(raw, off)
    assert [raw[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)] == [b"ab", b"c", b"d", b"e", b"c"] and w.at.tolist() == [0, 2, 2, 2, 4, 5]
    h = w.hashes()
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    assert common.windows(h, w.at, 2)[0].tolist() == [0, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab\u00e9 ", max_size=40), max_size=5), st.sampled_from([2, 64]))
def test_word_numbers_are_exact(rows, bits):
    w = common.Words(*common.buffers(pa.array(rows, pa.string())))
    want = [x for t in rows for x in t.split()]
    ids, n = w.ids(w.hashes(bits))
    assert n == len(set(want)) and len(set(zip(ids.tolist(), want, strict=True))) == n == len(set(ids.tolist()))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 20])
def test_windows_are_polynomials(size):
    words_ = np.random.default_rng(size).integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
    at = np.array([0, 0, 25, 26, 60])
    want = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        for i in range(a, b - size + 1):
            v = 0
            for k in range(size):
                v = (v * common.BASE + int(words_[i + k])) % common.PRIME
            want.append((i, int(common.mix(np.array([v], np.uint64))[0])))
    got = common.windows(words_, at, size)
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_long_words_differ():
    rows = [thue_morse(n, x) for n in (512, 1024, 2048, 4096) for x in ("ab", "ba")]
    w = common.Words(*common.buffers(pa.array(rows)))
    assert len(set(w.hashes().tolist())) == len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    rows = [*texts(16), "123 456"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "substring_dedup", "best_fit_packing"]
    kept = {i: t for i, t in enumerate(rows) if t and re.search(r"[^\W\d_]", t)}
    docs = common.stash(p.identify_language(spark, docs, ""), "t")
    assert docs.columns == p.COLUMNS and {r.doc_id for r in docs.collect()} == set(kept)
    groups = collections.defaultdict(list)
    for i, t in kept.items():
        groups["".join(words(t))].append(i)
    kept = {i: kept[i] for ids in groups.values() for i in [min(ids, key=lambda i: (-len(kept[i]), i))]}
    docs = common.stash(p.drop_copies(spark, docs, ""), "t")
    assert {r.doc_id for r in docs.collect()} == set(kept)
    ids = sorted(kept)
    comp = components_by_hand([kept[i] for i in ids], 5, 80, 100)
    kept = {i: kept[i] for k, i in enumerate(ids) if comp[k][1] == k}
    docs = common.stash(p.drop_near_copies(spark, docs, ""), "t")
    assert {r.doc_id for r in docs.collect()} == set(kept)
    docs = common.stash(p.cut_passages(spark, docs, ""), "t")
    assert docs.columns == p.COLUMNS and {r.doc_id for r in docs.collect()} <= set(kept)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    packed = p.pack(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()} and sum(r.n_words for r in packed) == sum(len(words(r.text)) for r in docs.collect())


def test_lm_learns_context_of_every_text(spark):
    """Word counts stay the same, and the order of words changes only in texts outside the SAMPLE that starts the weights."""
    r = random.Random(17)
    lexicon = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(4)) for _ in range(150)]
    rows = [(i, " ".join(r.choice(lexicon) for _ in range(12))) for i in range(1200)]
    table = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    place = table(rows).select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64("doc_id", "text").alias("b"), (common.crc_fold(F.col("doc_id")) != 1).alias("learn")).collect()
    first = {x.doc_id for key in ("a", "b") for x in sorted((x for x in place if x.learn), key=lambda x: x[key])[: lm.SAMPLE]}
    late = {x.doc_id for x in place if x.learn} - first
    assert len(late) > 50
    changed = [(i, " ".join(sorted(t.split())) if i in late else t) for i, t in rows]
    score = lambda x: {y.doc_id: y for y in lm.score_texts(table(x), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    old, new = score(rows), score(changed)
    same = [i for i, _ in rows if i not in late]
    assert all(abs(old[i].base_score - new[i].base_score) < 1e-9 for i in same)
    assert sum(abs(old[i].score - new[i].score) > 1e-3 for i in same) > 0.9 * len(same)


@pytest.mark.parametrize("tongues", [1, 3])
def test_pipeline_rejects_what_no_learned_language_has(spark, tongues):
    import corpus_pipeline as p

    r = random.Random(18)
    speak = [("the", "of", "and", "tion", "ing"), ("der", "und", "schl", "ung", "ein"), ("que", "ción", "los", "ñar", "ado")][:tongues]
    rows = [(k, " ".join("".join(r.choice(speak[k % tongues]) for _ in range(r.randint(1, 3))) for _ in range(r.choice((1, 3, 40, 200)))), "abc"[k % tongues]) for k in range(300)]
    draw = lambda letters, n=900: "".join(r.choice(letters) for _ in range(n))
    odd = ["мы долго шли по берегу реки и говорили о погоде", "これは日本語の文章です川の岸辺を長い間歩きながら話しました", draw("bcdfghjklmpqrvwxz "), draw("0123456789abcdef"), draw("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjklmnpqrstuvwxyz0123456789+/"), "a" * 900]
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 5 == 0]  # ids that are not learned from
    docs = spark.createDataFrame([(i, t, y, "s", len(t)) for i, t, y in [*rows, *[(k, t, "a") for k, t in zip(held, odd)]]], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in p.identify_language(spark, docs, "").collect()} == {i for i, _, _ in rows}


def test_host_boilerplate_across_shards(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SHARD", 4)
    line = lambda k: f"section notice number {k} stands on two pages of this large host only"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    pages = [(k, f"https://h.example/{k}", f"<body><div>{line(k % 20)}</div><div>{own(k)}</div></body>") for k in range(40)]
    pages += [(50, "https://h.example/50", f"<body><div>{own(50)} {own(50)}</div></body>"), (51, "https://other.example/", f"<body><div>{line(1)}</div></body>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{k: own(k) for k in range(40)}, 50: f"{own(50)} {own(50)}", 51: line(1)}


def test_jaccard_compares_each_group_of_sets_once(spark, monkeypatch):
    """Texts that share a passage and are no links: keys of two sets, and keys with the same sets, are not compared again."""
    r = random.Random(31)
    own = lambda n: [f"o{r.randrange(10**6)}" for _ in range(n)]
    shared, pairs = own(60), [own(60) for _ in range(12)]
    rows = [" ".join([*shared, *own(60)]) for _ in range(8)] + [" ".join([*p, *own(60)]) for p in pairs for _ in range(2)]
    rows += [" ".join([*shared, *"a b c d e f g h".split(), *(f"n{k}" for k in range(52)), f"z{k}"]) for k in range(3)]
    written, stash = {}, common.stash
    monkeypatch.setattr(common, "stash", lambda df, tag: written.setdefault(tag, []).append(stash(df, tag)) or written[tag][-1])
    monkeypatch.setattr(common, "drop", lambda *_: None)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(frame(spark, rows), words=5, num=80, den=100).collect()}
    assert got == components_by_hand(rows, 5, 80, 100) and got[len(rows) - 1][1] == len(rows) - 3
    for opened in written["open"]:
        groups = collections.defaultdict(set)
        for x in opened.collect():
            groups[x.key].add(x.node)
        assert all(len(g) > 2 for g in groups.values()) and len({frozenset(g) for g in groups.values()}) == len(groups)
        assert not any("keys" in c for c in opened.columns)
    assert written["open"][0].count()


def test_jaccard_pairs_no_key_with_itself(spark, monkeypatch):
    """Texts that share a passage and are no links meet by their rarest shingles, not in pairs behind each key; texts that link only
    to each other behind the same passage are found."""
    r = random.Random(41)
    own = lambda n: [f"o{r.randrange(10**6)}" for _ in range(n)]
    shared = own(90)
    rows = [" ".join([*shared, *own(60)]) for _ in range(60)]
    for _ in range(20):
        base = [*shared, *own(60)]
        rows += [" ".join([*base[:-8], *own(8)]) for _ in range(2)]
    made, stash = {}, common.stash
    monkeypatch.setattr(common, "stash", lambda df, tag: made.setdefault(tag, []).append(stash(df, tag)) or made[tag][-1])
    monkeypatch.setattr(common, "drop", lambda *_: None)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(frame(spark, rows), words=5, num=80, den=100).collect()}
    assert got == components_by_hand(rows, 5, 80, 100) and len({c for _, c in got.values()}) == 80
    hot = {x.key: x["count"] for x in made["open"][0].groupBy("key").count().collect()}
    assert max(hot.values()) > 40 and made["rest"][0].count() <= len(rows)
