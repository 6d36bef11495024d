"""Lexical search, vector codes and vector search against slow versions written from their definitions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lexical_search, vector_codes, vector_search
from corpusloom.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, item_id string, score int, shard int"


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=50):
    held = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for doc, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            found.append((-s, doc is None, doc))
        found = sorted(x for x in found if x[0] < 0)[:k]
        out += [(item, n, doc, -s) for n, (s, _, doc) in enumerate(found, 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ähre", "x9", "the"]
    text = lambda a, b: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(a, b)))
    docs = [(i, text(1, 40)) for i in range(n)] + [(n + 1, None), (n + 2, ""), (n + 3, "-- ,"), (None, "w3 w5 w5"), (None, text(3, 9)), (4, "W1_w2-W3"), (n + 4, "w7 " * 3000)]
    docs += [(n + 5 + i, "w1 w2 w3") for i in range(80)]  # ties beyond the fiftieth place
    return docs, [(i, text(1, 8)) for i in range(9)] + [(9, None), (10, "nowhere"), (11, "w1"), (11, "W2"), (None, "w40 x9"), (12, "ÄHRE Ähre")]


@pytest.mark.parametrize(("seed", "k", "limits"), [(1, 50, {}), (2, 5, {"shard": 40, "leaf": 8}), (3, 3, {"shard": 64, "leaf": 1, "most_terms": 6, "most_cells": 20})])
def test_lexical_search(spark, seed, k, limits):
    docs, items = corpus(seed, 300)
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, doc_id int")
    got = [tuple(r) for r in lexical_search.ranked(d, q, k=k, **limits).collect()]
    assert sorted(got, key=str) == brute(docs, items, k)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a a")], [(1, "A")])])
def test_lexical_search_of_small_tables(spark, docs, items):
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert [tuple(r) for r in lexical_search.ranked(d, q).collect()] == brute(docs, items)


@pytest.mark.parametrize("clash", [False, True])
def test_terms_are_compared_byte_by_byte(monkeypatch, clash):
    hashes = lexical_search.C.Words.hashes
    monkeypatch.setattr(lexical_search.C.Words, "hashes", lambda self, bits=64: hashes(self) & np.uint64(1 if clash else (1 << 64) - 1))
    known = lexical_search.Vocabulary([b"abc", b"abcdefghijk", b"zz"])
    w = lexical_search.terms_of(*lexical_search.C.buffers(pa.array(["ABC abcdefghij zz,abcdefghijk", "abcdefghijK q zz"])))
    at, number = known.find(w)
    assert (at.tolist(), number.tolist()) == ([0, 2, 3, 4, 6], [0, 2, 1, 1, 2])


def test_bisection_parts_what_does_not_mix():
    rng = np.random.default_rng(0)
    n, kind = 512, np.random.default_rng(1).integers(0, 4, 512)
    doc, term = np.repeat(np.arange(n), 6), (np.repeat(kind, 6) * 20 + rng.integers(0, 20, n * 6))
    order, bounds = lexical_search.bisect(doc, term, n, 64)
    assert sorted(order.tolist()) == list(range(n)) and bounds[0] == 0 and bounds[-1] == n and np.diff(bounds).max() <= 64
    pure = [np.bincount(kind[order[a:b]]).max() / (b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert np.mean(pure) > 0.9


def test_clusters_below_the_floor_stay_closed(monkeypatch):
    opened = []
    scores = lexical_search.Block.scores
    monkeypatch.setattr(lexical_search.Block, "scores", lambda self, batch, c, items: opened.append(c) or scores(self, batch, c, items))
    i4 = lambda *x: np.array(x, "<i4").tobytes()
    rows = [(c, [10 * c, 10 * c + 1], i4(0), i4(top), i4(0, 1), i4(0, 0), i4(top, top - 1)) for c, top in enumerate([5, 9, 7, 1])]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["cid", "ids", "heads", "tops", "docs", "places", "impacts"])
    block = lexical_search.Block([1], [[0]], {0: 3})
    out = list(lexical_search._visit(block, np.array([20]), 2, pa.int64(), pa.int64())(iter([batch])))
    assert opened == [1, 2] and out[0]["doc_id"].to_pylist() == [10, 11]


def codes(rows):
    """vec_id, code, error, label_error and digest by the definition, in whole numbers."""
    kept = sorted([(r[0] is None, r[0], [math.floor(1024 * x) for x in r[1]], r[2]) for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])], key=lambda r: (r[0], r[1] or 0, r[2]))
    width = len(kept[0][2]) // 4
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        part = [r[2][p * width : (p + 1) * width] for r in kept]
        book = part[:256]
        for turn in range(5):
            near = [min((far(x, e), j) for j, e in enumerate(book)) for x in part]
            if turn < 4:
                book = [[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := [x for x, (_, n) in zip(part, near, strict=True) if n == j]) else e for j, e in enumerate(book)]
        books += book
        for i, (d, j) in enumerate(near):
            code[i] += f"{j:02x}"
            error[i] += d
    label = collections.Counter()
    for r, e in zip(kept, error, strict=True):
        label[r[3]] += e
    sha = hashlib.sha256(",".join(str(v) for e in books for v in e).encode()).hexdigest()
    return sorted([(r[1], c, e, label[r[3]], sha) for r, c, e in zip(kept, code, error, strict=True)], key=str)


VECS = "vec_id bigint, embedding array<float>, label int, part int, code string, row int"


@pytest.mark.parametrize(("seed", "n", "heavy"), [(1, 600, 512), (2, 400, 3), (3, 20, 512)])
def test_vector_codes(spark, seed, n, heavy):
    rng = np.random.default_rng(seed)
    vec = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.004, 8)]  # noqa: E731  few distinct whole parts
    rows = [(i * 3, vec(), int(rng.integers(0, 3))) for i in range(n)] + [(9, vec(), None), (10, vec(), None), (None, vec(), 1)]
    rows += [(1000 + i, [0.25] * 8, 2) for i in range(n // 3)] + [(2, None, 1), (5, [None] * 8, 1), (7, [math.nan] + [0.0] * 7, 1), (8, [math.inf] * 8, 1), (11, [], 1)]
    rows += [rows[0]] * 2
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECS).repartition(3)
    got = [tuple(r) for r in vector_codes.encode(df, heavy=heavy).collect()]
    assert sorted(got, key=str) == codes(rows)


def test_vector_codes_of_odd_tables(spark):
    assert vector_codes.encode(spark.createDataFrame([], VECS)).collect() == []
    rows = [(1, [0.5] * 6, 1), (2, [0.25] * 6, 1), (3, [1.0] * 5, 1), (4, [9e9] * 6, 1)]
    got = {r.vec_id: r for r in vector_codes.encode(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECS)).collect()}
    assert sorted(got) == [1, 2, 4] and got[4].code == "02020202" and got[4].error == 0
    assert got[1].codebooks_sha256 == vector_codes.digest([np.array([[v] * w for v in (512, 256, 1 << 23)]) for w in (1, 2, 1, 2)])


def test_distances_are_whole_numbers():
    rng = np.random.default_rng(5)
    for most in (9, 1 << 23):
        x, book = rng.integers(-most, most, (50, 40)), rng.integers(-most, most, (7, 40))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in x]
        code, far = vector_codes.nearest(x, book)
        assert far.tolist() == [min(d) for d in exact] and code.tolist() == [d.index(min(d)) for d in exact]


def neighbours(rows, k=5):
    held = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.sqrt((v * v).sum()) for _, v in held])
    out = {}
    for n, (i, _) in enumerate(held):
        if i is not None and i % 50 == 0:
            s = x @ x[n]
            order = sorted((j for j in range(len(held)) if j != n), key=lambda j: (-round(s[j], 12), held[j][0] is None, held[j][0] or 0))[:k]
            out.setdefault(i, []).append([(held[j][0], s[j]) for j in order])
    return out


@pytest.mark.parametrize(("n", "options"), [(60, {}), (4000, {"list_size": 50, "cell": 1024, "queries": 16}), (4000, {"list_size": 512})])
def test_vector_search(spark, n, options):
    rng = np.random.default_rng(n)
    centre = rng.normal(0, 1, (12, 16))
    vec = lambda: [float(np.float32(x)) for x in centre[rng.integers(12)] + rng.normal(0, 0.6, 16)]
    same = vec()
    rows = [(i, vec()) for i in range(n)] + [(n + 1 + i, same) for i in range(n // 3)]
    rows += [(50_000, None), (50_050, [0.0] * 16), (50_100, [math.nan] * 16), (50_150, [None] * 16), (50_200, [1.0] * 3), (50_250, []), (None, vec()), (None, same), (100, vec()), (100, same)]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECS).repartition(3)
    got = collections.defaultdict(list)
    for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0, **options).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = neighbours(rows)
    assert set(got) == set(want)
    hit = total = 0
    known = collections.defaultdict(list)
    for i, v in rows:
        known[i].append(v)
    for q, sets in want.items():
        assert sorted(x[0] for x in got[q]) == sorted(list(range(1, 6)) * len(sets))
        for _, v, s in got[q]:  # exactly the measure, on some pair of rows with these ids
            pairs = [np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) for a in known[q] for b in known[v] if a and b and len(a) == len(b) == 16 and None not in a + b]
            assert min(abs(s - x) for x in pairs) < 1e-12
        total += 5 * len(sets)
        hit += sum((collections.Counter(x[1] for x in got[q]) & collections.Counter(v for one in sets for v, _ in one)).values())
    assert hit / total >= (0.9 if n > 60 else 1)


def test_vector_search_of_an_empty_table(spark):
    df = spark.createDataFrame([], VECS)
    assert vector_search.nearest(df, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(50, [1.0, 2.0], 1, 1, "x", 1), (51, None, 1, 1, "x", 1)], VECS)
    assert vector_search.nearest(one, F.col("vec_id") % 50 == 0).collect() == []


def test_scan_reads_few_components_and_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x = vector_search.unit(np.repeat(rng.normal(0, 1, (100, 64)), 30, axis=0) + rng.normal(0, 0.3, (3000, 64)))
    q = vector_search.unit(x[:20] + rng.normal(0, 0.02, (20, 64)))
    turn = vector_search.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    blocks = [(x @ turn)[:, j : j + 16] for j in range(0, 64, 16)]
    for i in range(20):
        rows, read = vector_search.scan(q[i] @ turn, blocks, [(0, 1000), (1000, 3000)], -1, 5)
        assert i in rows and read < 0.5 * 3000 * 64
        assert len(set(np.argsort(-(x @ q[i]))[:5]) & set(rows.tolist())) >= 4


@pytest.mark.parametrize("sizes", [[], [0, 3], [10, 10, 10], [3, 25, 4, 4], [100]])
def test_cells(sizes):
    cells, count = vector_search.layout(sizes, 10)
    room = collections.Counter()
    for (first, many), n in zip(cells, sizes, strict=True):
        for c in range(first, first + many):
            assert c < max(1, count)
            room[c] += n / many
    assert all(n <= 10 for n in room.values())


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    got = collections.defaultdict(list)
    for r in QUERIES["op13_vector_search"](spark, sf).collect():
        got[r.query_id].append(r.vec_id)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = vector_search.unit(np.stack(rows.embedding).astype(float))
    ids = rows.vec_id.to_numpy()
    hit = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hit += len(set(ids[np.argsort(-s, kind="stable")[:5]].tolist()) & set(got[q]))
    assert len(got) == (ids % 50 == 0).sum() and hit / (5 * len(got)) >= 0.95
