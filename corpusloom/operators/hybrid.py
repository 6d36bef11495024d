"""Hybrid ranking of chunks: cosine of hashed vectors, a keyword bonus, and the question's focus, in tiers.

The question is read on the driver (a few words). Chunks are written once with their words and hashed places; then one pass over their vocabulary finds the words that
stand for the question's words, one aggregate their document frequencies, and one projection the scores. Only these words and few numbers go back as
literals; scores never need all chunks in one place, and the best k are a TakeOrderedAndProject.

Vectors are signed feature hashing of words, a deterministic stand-in for a sentence model: a chunk's dot products are sums over its words, and no
dense vector is built. A word matches literally (1), by a similar word (see operators.similar; the cosine) or by its stem (0.9).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from . import retrieval as V
from . import similar as S

#: Weights of the keyword bonus, of the focus, of a phrase's words that stand alone, of the wrong polarity; the least
#: similarity of a partner to its phrase.
BOOST, FOCUS, SOLO, MISMATCH, PARTNER = V.BOOST, 0.55, V.SOLO, V.MISMATCH, 0.35


@dataclass(frozen=True)
class Question:
    """What the ranking asks: its significant words, chains of adjacent ones, and which are negated."""

    text: str
    words: tuple[str, ...]
    chains: tuple[tuple[str, ...], ...]
    negated: frozenset[str]

    @classmethod
    def read(cls, text: str) -> Question:
        words = tuple(V.question_words(text))
        return cls(text, words, tuple(map(tuple, chains(bigrams(text)))), frozenset(w for w in words if V.negated_literal(text, w)))


def bigrams(text: str) -> list[tuple[str, str]]:
    """Adjacent pairs of significant words."""
    tokens = re.findall("[a-z0-9]+", text.lower())
    good = [len(t) >= 3 and t not in T.STOPWORDS for t in tokens]
    return [(a, b) for a, b, x, y in zip(tokens, tokens[1:], good, good[1:], strict=False) if x and y]


def chains(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Pairs that overlap put together, each at the first chain whose end or beginning it meets."""
    out: list[list[str]] = []
    for a, b in pairs:
        for c in out:
            if c[-1] == a:
                c.append(b)
                break
            if c[0] == b:
                c.insert(0, a)
                break
        else:
            out.append([a, b])
    return out


@dataclass(frozen=True)
class Focus:
    """The phrase that the question is about, its rarest word, a word that may stand for it, and the anchor of each chained word."""

    word: str | None
    phrase: tuple[str, ...]
    partner: str | None
    gate: dict[str, str]


def focus(q: Question, idf: dict[str, float], similar=None) -> Focus:
    """Of words with a weight: negated ones outside chains come first, then negated ones, then those outside chains, then the anchors of
    chains; the rarest is the focus (the first of equals). `similar(word, phrase)` is a cosine, by default of hashed vectors."""
    similar = similar or hashed_similarity
    gate = {}
    for c in q.chains:
        known = [w for w in c if w in idf]
        if len(known) > 1:
            anchor = max(known, key=idf.get)
            gate |= {w: anchor for w in known if w != anchor}
    chained = {w for c in q.chains for w in c}
    pools = ([w for w in idf if w in q.negated and w not in chained], [w for w in idf if w in q.negated], [w for w in idf if w not in chained], [w for w in idf if w in set(gate.values())], list(idf))
    pool = next((p for p in pools if p), [])
    word = max(pool, key=idf.get) if pool else None
    phrase = next((c for c in q.chains if word in c), (word,) if word else ())
    mates = [w for w in phrase if w != word and w in idf and similar(w, " ".join(phrase)) >= PARTNER]
    return Focus(word, phrase, min(mates, key=idf.get) if mates else None, gate)


def hashed_similarity(word: str, phrase: str) -> float:
    """Cosine of the hashed vectors of a word and of a phrase that contains it, without collisions: 1 / sqrt(number of words)."""
    words = phrase.split()
    return len(words) ** -0.5 if word in words else 0.0


def proximity(low: Column, words: tuple[str, ...], width: int) -> Column:
    """Whether every other word's stem stands within `width` characters of the first word's."""
    first, out = re.escape(V.stem_of(words[0])), F.lit(True)
    for w in words[1:]:
        other = re.escape(V.stem_of(w))
        out = out & low.rlike(f"(?s){first}.{{0,{width}}}?{other}|{other}.{{0,{width}}}?{first}")
    return out


def rank(chunks: DataFrame, ident: list[str], text: str, question: str, k: int = 10, boost: float = BOOST, dim: int = 256, where: Column | None = None) -> DataFrame:
    """The k best chunks: ident, score, semantic, bonus, lift, evidence, has_focus, has_partner, matched. Chunks that speak of the focus come
    first, then those that have its partner, then by score, then by ident. A boost of 0 leaves the cosine and the focus alone."""
    q = Question.read(question)
    pool = chunks if where is None else chunks.where(where)
    held = written(pool.select(*ident, F.col(text).alias("text"), F.array_distinct(T.words(F.col(text))).alias("words"), V.hash_places(F.col(text), dim).alias("places")), "chunks")
    levels = alike(held, q.words)
    rows = held.select(*ident, "text", "places", *[strength(levels[w]).alias(f"s{i}") for i, w in enumerate(q.words)])
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"s{i}") > 0).alias(f"d{i}") for i in range(len(q.words))]).first()
    n, df = found["n"], {w: found[f"d{i}"] for i, w in enumerate(q.words)}
    idf = {w: idf_of(df[w], n) for w in q.words}
    f = focus(q, idf)
    s = {w: F.col(f"s{i}") for i, w in enumerate(q.words)}
    opposite = {w: (s[w] > 0) & (F.coalesce(polarity(levels[w], s[w]), F.lit(w in q.negated)) != F.lit(w in q.negated)) for w in q.words}
    low = F.lower("text")
    both = {(a, b): proximity(low, (a, b), T.WINDOW) for a, b in f.gate.items()}
    weight = lambda w: s[w] * float(idf[w] * saturation_of(df[w], n)) * F.when(opposite[w], MISMATCH).otherwise(1.0) * (F.when((s[f.gate[w]] > 0) & both[w, f.gate[w]], 1.0).otherwise(SOLO) if w in f.gate else F.lit(1.0))
    bonus = F.lit(boost) * V.noisy_or(F.array(*[weight(w) for w in q.words])) if q.words else F.lit(0.0)
    phrase = " ".join(f.phrase)
    asked, sought = chunks.sparkSession.range(1).select(V.hash_vector(F.lit(question), dim), V.hash_vector(F.lit(phrase), dim)).first()
    norm = V.hash_norm(F.col("places"), dim)
    cosine = lambda vector: F.coalesce(F.try_divide(V.hash_dot(F.col("places"), vector), norm), F.lit(0.0))
    semantic = cosine(asked)
    lift, has, partner, evidence = F.lit(0.0), F.lit(False), F.lit(False), F.lit("no_evidence")
    if f.word:
        lift = FOCUS * F.greatest(cosine(sought), F.lit(0.0))
        has = s[f.word] > 0
        whole = has
        if len(f.phrase) > 1:
            for w in f.phrase:
                whole = whole & (s[w] > 0)
            whole = whole & proximity(low, f.phrase, T.WINDOW * (len(f.phrase) - 1))
        lift = lift * F.when(has & ~whole, SOLO).when(whole & opposite[f.word], MISMATCH).otherwise(1.0)
        has = whole
        says_no = opposite[f.word] != F.lit(f.word in q.negated)
        evidence = F.when(has & says_no, "confirmed_absent").when(has, "confirmed_present").otherwise("no_evidence")
        partner = s[f.partner] > 0 if f.partner else F.lit(False)
    matched = F.array_compact(F.array(*[F.when(s[w] > 0, F.lit(w)) for w in q.words])) if q.words else F.array().cast("array<string>")
    scored = rows.select(*ident, semantic.alias("semantic"), bonus.alias("bonus"), lift.alias("lift"), evidence.alias("evidence"), has.alias("has_focus"), partner.alias("has_partner"), matched.alias("matched"))
    scored = scored.withColumn("score", F.col("semantic") + F.col("bonus") + F.col("lift"))
    return scored.orderBy(F.desc(F.col("has_focus") | F.col("has_partner")), F.desc("has_focus"), F.desc("score"), *ident).limit(k)


def alike(chunks: DataFrame, words: tuple[str, ...]) -> dict[str, list[tuple[float, list[str]]]]:
    """Of each word, (strength, the chunks' words that stand for it with this strength), best first: itself, similar ones, those of its stem."""
    out: dict[str, list[tuple[float, list[str]]]] = {w: [(1.0, [w])] for w in words}
    if not words:
        return out
    known = chunks.select(F.explode("words").alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(*T.STOPWORDS)).distinct()
    found: dict[tuple, list[str]] = {}
    for r in S.concepts_of(list(words), known).where("tier > 0").collect():  # words that look like a few words
        found.setdefault((r["asked"], r["tier"], -r["strength"]), []).append(r["known"])
    for (w, _, less), own in sorted(found.items()):
        out[w].append((-less, sorted(own)))
    return out


def strength(levels: list[tuple[float, list[str]]]) -> Column:
    """How a chunk's `words` speak of a word: by its best level."""
    out = F.when(F.array_contains("words", levels[0][1][0]), levels[0][0])
    for s, own in levels[1:]:
        out = out.when(F.exists("words", lambda x: x.isin(*own)), s)  # noqa: B023
    return out.otherwise(0.0)


def polarity(levels: list[tuple[float, list[str]]], s: Column) -> Column:
    """Whether the word that gave a chunk its strength is negated there."""
    out = F.lit(None).cast("boolean")
    for level, own in reversed(levels):
        out = F.when(F.abs(s - level) < 1e-12, T.negated(F.col("text"), own[0] if len(own) == 1 else "(?:" + "|".join(own) + ")")).otherwise(out)
    return out


def idf_of(df: int, n: int) -> float:
    import math

    return 1.0 if n <= 1 or df <= 0 else math.log((n + 1) / (df + 1)) / math.log((n + 1) / 2)


def saturation_of(df: int, n: int) -> float:
    share = df / n if n else 0.0
    return 1.0 if share <= V.FULL_FROM else 0.0 if share >= V.NONE_FROM else 1.0 - (share - V.FULL_FROM) / (V.NONE_FROM - V.FULL_FROM)


def chunk_title(title: Column, heading: Column, site: Column) -> Column:
    """The title of a chunk: the page's title, with the heading and the site's name where they are not in it yet."""
    has = lambda a, b: F.contains(F.lower(a), F.lower(b))
    base = T.clean(title)
    one = F.when((F.coalesce(heading, F.lit("")) != "") & ~has(base, heading), F.concat_ws(" - ", F.nullif(base, F.lit("")), heading)).otherwise(base)
    return F.when((F.coalesce(site, F.lit("")) != "") & ~has(one, site), F.concat_ws(" | ", F.nullif(one, F.lit("")), site)).otherwise(one)


def is_about(word: str, anchors: list[str], similar=None, least: float = 0.60) -> bool:
    """Whether a word of the question is one of some anchors (place names, say) or similar enough to one."""
    return word in anchors or any((similar or hashed_similarity)(word, a) >= least for a in anchors)


def respelled(question: str, known: dict[str, str]) -> str:
    """The question with words replaced by a table of corrections; for the vector alone, matching keeps the words as they are."""
    return re.sub("[A-Za-z0-9]+", lambda m: known.get(m[0].lower(), m[0]), question)
