"""Similar words against all pairs, and what they do in the ranking."""

import math
import random

from pyspark.sql import functions as F

from corpusloom.operators import hybrid, similar


def grams(w):
    m = f"<{w}>"
    return {m[i : i + n] for n in (2, 3) for i in range(max(1, len(m) - n + 1))}


def cosine(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / math.sqrt(len(x) * len(y))


def test_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choices("abcde", k=rng.randint(0, 9))) for _ in range(400)})
    asked = [*rng.sample(known, 20), "aé", "none such", "x"]
    df = lambda words: spark.createDataFrame([(w, 1) for w in words] + [(None, 1)] * 2 + [(words[0], 1)], "word string, n int")
    got = {(r.asked, r.known): r.cosine for r in similar.pairs(df(asked), df(known)).collect()}
    want = {(a, k): cosine(a, k) for a in asked for k in known if cosine(a, k) >= 0.6 - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert similar.pairs(df(asked), df(known).limit(0)).collect() == []


def test_strengths_take_the_first_tier(spark):
    texts = [(1, "bookings here"), (2, "we book now"), (3, "a booking"), (4, "nothing"), (5, None), (6, "books booker")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    asked = spark.createDataFrame([("booking",), ("book",)], "word string")
    got = {(r.doc_id, r.word): (r.matched, round(r.strength, 4)) for r in similar.strengths(df, "doc_id", "text", asked).collect()}
    assert got == {(r.doc_id, r.word): (r.matched, round(r.strength, 4)) for r in similar.strengths(df, "doc_id", "text", ["booking", "book"]).collect()}
    stem = lambda w: next((w[: -len(x)] for x in ("ing", "edly", "ed", "es", "s") if w.endswith(x) and len(w) - len(x) >= 3), w)
    want = {}
    for i, t in texts:
        for q in ("booking", "book"):
            ways = [(0, -1.0, w) if w == q else (1, -cosine(q, w), w) if cosine(q, w) >= 0.6 else (2, -0.9, w) for w in (t or "").split() if w == q or cosine(q, w) >= 0.6 or stem(w) == stem(q)]
            want |= {(i, q): (min(ways)[2], round(-min(ways)[1], 4))} if ways else {}
    assert got == want and {x[1] for x in want.values()} >= {1.0} and len(want) >= 6


def test_ranking_follows_similar_words_and_their_polarity(spark):
    rows = [(1, "plain talk about weather"), (2, "online reservations are open"), (3, "there are no reservations here"), (4, "weather again")]
    df = spark.createDataFrame(rows, "doc_id int, chunk string")
    got = {r.doc_id: r for r in hybrid.rank(df, ["doc_id"], "chunk", "reservation", dim=4096).collect()}
    assert [got[k].evidence for k in (1, 2, 3, 4)] == ["no_evidence", "confirmed_present", "confirmed_absent", "no_evidence"]
    assert got[2].matched == ["reservation"] and got[2].bonus > got[3].bonus > 0 == got[1].bonus


def test_ranking_without_words_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id int, chunk string")
    assert [r.doc_id for r in hybrid.rank(df, ["doc_id"], "chunk", "of the").collect()] == [1, 2, 3]
    assert hybrid.rank(df.where(F.lit(False)), ["doc_id"], "chunk", "app store").collect() == []
