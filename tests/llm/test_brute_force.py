"""Learned operators and shared pieces against slow versions written from their definitions, and odd rows through every operator."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, exact_dedup, html_text, jaccard, language_id, lm, packing, quality, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def word_hash(b):
    out = mix(len(b))
    for k in range(0, len(b), 8):
        out = mix(((out * 0x9E3779B97F4A7C15) & M64) ^ int.from_bytes(b[k : k + 8], "little"))
    return out


def test_word_hash():
    import pyarrow as pa

    rows = ["", "a", "abcdefgh", "abcdefghi é x", "  ü\t" + "q" * 40]
    w = common.Words(*common.buffers(pa.array(rows)))
    assert w.hashes().tolist() == [word_hash(x.encode()) for t in rows for x in WORD.findall(t)]


def test_even_labels_fill_every_partition(spark):
    for n in (1, 2, 7, 50):
        labels = common.even_labels(spark, n)
        df = spark.range(n + 1).select(common.labelled(F.col("id").cast("int"), labels).alias("k"))
        got = [r.k for r in df.collect()]
        assert len(set(got)) == n + 1
        parts = df.where(F.col("k") != got[-1]).repartition(n, "k").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts == n


# Quality classifier: features, the learner and scores.


def grams(text):
    """Places of the five kinds of grams of a text."""
    words = [w.encode() for w in WORD.findall(text or "")]

    def shape(b):
        out = bytearray()
        for c in b:
            s = ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
            if not out or out[-1] != s:
                out.append(s)
        return bytes(out)

    place = lambda x, kind: mix((x + kind) & M64) >> (64 - quality.BITS)
    h, s = [word_hash(w) for w in words], [word_hash(shape(w)) for w in words]
    pair = lambda x: [(a * 3 + b) & M64 for a, b in zip(x, x[1:], strict=False)]
    return [[place(x, 1) for x in h], [place(x, 2) for x in pair(h)], [place(x, 3) for x in s], [place(x, 4) for x in pair(s)], [place(int(a == b), 5) for a, b in zip(h, h[1:], strict=False)]]


def scalar_ftrl(examples):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for at, x, y in examples:
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, v, wi in zip(at, x, w, strict=True):
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * wi
            n[i] += g * g
    return weight


def test_ftrl_is_per_coordinate():
    r = random.Random(4)
    examples = [(np.array(sorted(r.sample(range(12), 5))), np.array([r.uniform(-2, 2) for _ in range(5)]), r.randrange(2)) for _ in range(200)]
    model = quality.FTRL()
    for e in examples:
        model.update(*e)
    want = scalar_ftrl([(a.tolist(), x.tolist(), y) for a, x, y in examples])
    assert np.allclose(model.weights()[:12], [want(i) for i in range(12)], atol=1e-12)


def test_quality_scores(spark):
    r = random.Random(5)
    docs = [(k, " ".join("".join(r.choice("abcÄ9.#") for _ in range(r.randint(1, 12))) for _ in range(r.choice((0, 1, 2, 60))))) for k in range(80)] + [(99, None)]
    labels = [(k, k % 2) for k in range(0, 80, 2)] + [(4, 1), (None, 1), (6, None)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.fit(d, lab, "doc_id", "text", "quality", common.crc_fold(F.col("doc_id")) != 0)
    got = {x.doc_id: x.score for x in quality.quality(d, lab).collect()}
    for k, t in docs:
        total = weights[-1] + sum(quality.SCALE * sum(weights[p] for p in places) / max(1, len(places)) for places in grams(t))
        assert abs(got[k] - 1 / (1 + math.exp(-total))) < 1e-9


# Language ID: grams, kernel and regression.


def language_grams(text):
    out = collections.Counter()
    letters = [ord(c) if c.isalpha() else 32 for c in f" {(text or '').lower()} "]
    for n in language_id.GRAMS:
        for i in range(len(letters) - n + 1):
            if any(c != 32 for c in letters[i : i + n]):
                h = n
                for c in letters[i : i + n]:
                    h = (h * 0x100000001B3 + c) & M64
                out[mix(h) >> (64 - language_id.DIM_BITS)] += 1
    return out


def test_language_kernels_and_scores():
    r = random.Random(6)
    speak = {"aa": ("the", "of", "tion"), "bb": ("der", "und", "schl")}
    rows = [(y, " ".join(r.choice(speak[y]) + r.choice(speak[y]) for _ in range(r.randint(1, 30))) + r.choice(("", " 7!", " É"))) for y in sorted(("aa", "bb") * 25)]  # landmarks stand in the order of labels
    counts, has = language_id.gram_counts([t for _, t in rows] + [None, "12"])
    assert has.tolist() == [True] * 50 + [False] * 2
    for (_, t), row in zip(rows, counts, strict=False):
        want = language_grams(t)
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == dict(want)
    x = (counts[:50] > 0).astype(np.float32)
    sets = [set(language_grams(t)) for _, t in rows]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(language_id.Model.kernel(x, x), kernel, atol=1e-5)
    # With every text a landmark, Nystroem ridge regression is the minimiser over functions K a + b; compare its objective with nearby ones.
    y = [v for v, _ in rows]
    model = language_id.Model.fit(x, y)
    target = np.array([[1.0 if v == k else -1.0 for k in model.labels] for v in y])

    def objective(a, b):
        return float((((kernel @ a + b) - target) ** 2).sum() + language_id.RIDGE * (np.einsum("ij,ik,kj->", a, kernel, a) + (b**2).sum()))

    a, b = model.weights[:-1].astype(np.float64), model.weights[-1].astype(np.float64)
    rng = np.random.default_rng(1)
    best = objective(a, b)
    for _ in range(20):
        assert objective(a + rng.normal(0, 0.02, a.shape), b + rng.normal(0, 0.02, b.shape)) > best * 0.999
    pick, p = model.score(x)
    for i, row in enumerate(kernel):
        s = row @ a + b
        e = [math.exp(4 * (v - max(s))) for v in s]
        assert pick[i] == int(np.argmax(s)) and abs(p[i] - 1 / sum(e)) < 1e-3


# Packing: every shard is packed by itself.


def best_fit_by_hand(rows, capacity):
    bins, want = [], {}
    order = packing.pieces([len(WORD.findall(t or "")) for _, t, _ in rows], capacity)
    for row, k, n in order:
        i, t, s = rows[row]
        c = "".join(WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})))
        fit = [b for b in bins if b["free"] >= n and c not in b["clusters"] and (s is None or s not in b["sources"])]
        b = min(fit, key=lambda b: (b["free"], b["since"])) if fit else None
        if b is None:
            b = {"id": len(bins), "free": capacity, "clusters": set(), "sources": set()}
            bins.append(b)
        want[i, k] = (b["id"], capacity - b["free"], n)
        b["free"] -= n
        b["since"] = len(want)
        b["clusters"].add(c)
        b["sources"] |= {s} - {None}
    return want


def test_packing_of_each_shard(spark):
    r = random.Random(9)
    docs = [(k, " ".join(f"q{r.randrange(9999)}" for _ in range(r.choice((0, 1, 5, 20, 33, 70)))), "hot" if k % 3 == 0 else r.choice((None, "a", "b"))) for k in range(200)]
    got = packing.best_fit(spark.createDataFrame(docs, "doc_id long, text string, source string"), capacity=32, shard=40).collect()
    shards = collections.defaultdict(set)
    for x in got:
        shards[x.shard].add(x.doc_id)
    assert len(shards) == 5 and sum(map(len, shards.values())) == 200
    for s, ids in shards.items():
        want = best_fit_by_hand([d for d in docs if d[0] in ids], 32)
        assert {(x.doc_id, x.piece): (x.bin, x.bin_offset, x.n_words) for x in got if x.shard == s} == want


# Language model: fused, clipped scoring against one position at a time.


def test_log_probs_position_by_position():
    rng = np.random.default_rng(3)
    model = lm.Model(rng, rng.integers(0, 60, 50), rng.integers(0, lm.CLASSES, 50), rng.integers(0, 9, 50), rng.normal(-2, 1, (9, 50)).astype(np.float16))
    model.prepare()
    p = {k: w.astype(np.float64) for k, w in model.p.items()}
    lens = np.array([5, 40, 1, 70])
    ids = rng.integers(0, 50, int(lens.sum()))
    x, real, y, use = lm.cut_windows(ids, lens, 49)
    got = model.log_probs(x, real, y)[use]
    want, at = [], 0
    for n in lens:
        own, at = ids[at : at + n], at + n
        inputs = [49, *own[:-1]]
        for i in range(n):
            first = max(0, i // lm.STRIDE * lm.STRIDE - lm.STRIDE)  # the window of this position begins there
            shift = lm.STRIDE - (i // lm.STRIDE * lm.STRIDE - first)
            seen = [p["emb"][model.rows[inputs[j]]] + p["pos"][j - first + shift] for j in range(first, i + 1)]
            q = seen[-1] @ p["q"]
            a = np.array([q @ (v @ p["k"]) for v in seen]) / math.sqrt(lm.WIDTH)
            a = np.exp(a - a.max())
            c = sum(w * (v @ p["v"]) for w, v in zip(a / a.sum(), seen, strict=True)) @ p["o"]
            h = seen[-1] + c
            h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
            o = h @ p["u"] + p["bias"]
            want.append(o[model.classes[own[i]]] - math.log(np.exp(o - o.max()).sum()) - o.max() + float(model.within[model.groups[inputs[i]], own[i]]))
    assert np.allclose(got, want, atol=2e-4)


# Odd rows through every operator.

CLASH = "doc_id long, text string, lang string, source string, quality int, __id string, __text string, k int, t int, b int, h string, n long, node long, bin long, __k int, __t int, id long, body string"
OPERATORS = {
    "substring": substring_dedup.substring_dedup, "exact": exact_dedup.exact_dedup, "jaccard": jaccard.jaccard_components, "language": language_id.language_id,
    "bpe": lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.json")), "quality": lambda d: quality.quality(d.drop("quality"), d.select("doc_id", "quality")),
    "rules": lambda d: quality_rules.quality_rules(d.drop("quality"), d.select("doc_id", "quality")),
    "lm": lambda d: lm.score_texts(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "pages": lambda d: html_text.main_text(d.withColumn("url", F.col("source")), id_col="doc_id", html_col="text").withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", [*OPERATORS, "packing"])
def test_odd_rows(spark, name):
    """Null ids, texts and labels, empty and very long texts, repeated rows, one language, and columns that share names with inner ones."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, "one text of a few words"), (1, "one text of a few words"), (1, "another text under the same id"), (None, "a text without an id"), (None, None), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, long), (7, "x" * 300_000), (8, "<p>ünïcode &amp; 漢字 🎉")]
    full = [(i, t, None if i == 2 else "en", None if i == 3 else "s", None if i == 4 else 1, "p", "q", 1, 2, 3, "r", 4, 5, 6, 7, 8, 9, "z") for i, t in rows]
    df = spark.createDataFrame(full, CLASH)
    if name == "packing":
        out = packing.best_fit(df).select("doc_id", "n_words").collect()
        assert sum(r.n_words for r in out) == sum(len(WORD.findall(t or "")) for _, t in rows)
        return
    got = collections.Counter(r.doc_id for r in OPERATORS[name](df).collect())
    assert got == collections.Counter(i for i, _ in rows)


def test_pipeline_judges_rows_that_repeat_an_id(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, "A  text of words"), (5, "A text of words"), (5, "quite another story here"), (None, "A textof words"), (None, "a lonely one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    kept = {(r.doc_id, r.text) for r in p.drop_copies(spark, docs, "").collect()}
    assert kept == {(3, "A  text of words"), (5, "quite another story here"), (None, "a lonely one")}
    near = [(1, "one two three four five six"), (2, "one two three four five six"), (2, "seven eight nine ten eleven"), (None, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in near], schema)
    assert {(r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, "").collect()} == {(1, near[0][1]), (2, near[2][1])}


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, ""), "t")
        assert docs.columns == p.COLUMNS and docs.count() == 0
    assert p.STAGES[-1][1](spark, docs, "").count() == 0


def test_equal_scores_take_the_first(spark):
    """Ties: equal texts get equal scores; of equally large groups the least id stays; equal texts of two languages have one prediction."""
    docs = spark.createDataFrame([(k, "same words in both", "ab"[k % 2]) for k in range(40)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.language_id(docs).collect()} == {"a"}
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert docs.count() == 40 and len({round(r.score, 12) for r in quality.quality(docs, labels).collect()}) == 1
    assert len({r.kept for r in quality_rules.quality_rules(docs, labels).collect()}) == 1
