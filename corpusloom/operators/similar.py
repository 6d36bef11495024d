"""Words that look alike: a similarity join over distinct words, and how strongly texts match the words of a question.

A word's vector has its distinct character n-grams (2 and 3, with its ends marked); similarity is the cosine. It stands in for the
vectors of a sentence model, which are not at hand. The join is exact: with the rarest grams first, two words of cosine t or more share a gram among the first
n - ceil(t * t * n) + 1 of each, and their sizes are within a factor t * t. So words meet by (size band, gram of the prefix). Parities of grams over 128 places then
bound from below how many grams are in one word only, which rules out most pairs in generated code; the rest are compared whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import STEM, stem_of

#: Least cosine at which two words are taken for one concept.
LEAST = 0.60


def grams(word: Column) -> Column:
    """Distinct 2- and 3-grams of a word with its ends marked."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.substring(marked, i, F.lit(n)))
    return F.array_distinct(F.concat(of(2), of(3)))


def sketch(grams: Column, half: int) -> Column:
    """For 64 of 128 places, whether an odd number of grams hash there."""
    place = lambda g: F.pmod(F.xxhash64(g), F.lit(128)).cast("int")
    own = F.filter(F.transform(grams, place), lambda p: F.shiftright(p, 6) == half)
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, p: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(63))))


def pairs(asked: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """(asked, known, cosine) of all pairs of cosine `least` or more. Both sides have a column `word`; nulls have no pairs."""
    sides = [df.select("word").where("word IS NOT NULL").distinct().select("word", grams(F.col("word")).alias("grams")) for df in (asked, known)]
    share, width = least * least, math.log(1 / (least * least))
    rarity = sides[1].select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def keyed(side: DataFrame) -> DataFrame:
        """(word, grams, gram, band) for each gram of the prefix."""
        each = side.select("word", F.explode("grams").alias("gram")).join(rarity, "gram", "left")
        ordered = each.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
        n = F.size("g")
        prefix = F.slice("g", F.lit(1), n - F.ceil(n * share - 1e-9).cast("int") + 1)
        plain = ordered.select("word", F.transform("g", lambda x: x["gram"]).alias("grams"), F.floor(F.log(n.cast("double")) / width).cast("int").alias("band"), F.transform(prefix, lambda x: x["gram"]).alias("prefix"))
        return plain.withColumns({"n": F.size("grams"), "s0": sketch(F.col("grams"), 0), "s1": sketch(F.col("grams"), 1)})

    one, two = (keyed(s) for s in sides)
    left = one.select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("b")).select(F.struct("word", "grams").alias("a"), F.col("n").alias("n1"), F.col("s0").alias("a0"), F.col("s1").alias("a1"), "b", F.explode("prefix").alias("gram"))
    right = two.select(F.struct("word", "grams").alias("k"), F.col("n").alias("n2"), F.col("s0").alias("k0"), F.col("s1").alias("k1"), F.col("band").alias("b"), F.explode("prefix").alias("gram"))
    sizes = F.col("n1").cast("double") * F.col("n2")
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("k0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("k1")))
    met = left.join(right, ["b", "gram"]).where(apart <= F.col("n1") + F.col("n2") - 2 * least * F.sqrt(sizes) + 1e-9)
    once = met.groupBy(F.col("a.word").alias("asked"), F.col("k.word").alias("known")).agg(F.first("a.grams").alias("g1"), F.first("k.grams").alias("g2"), F.first(sizes).alias("sizes"))
    common = once.withColumn("common", F.size(F.array_intersect("g1", "g2")))
    return common.where(F.col("common") * F.col("common") >= share * F.col("sizes") - 1e-9).select("asked", "known", (F.col("common") / F.sqrt("sizes")).alias("cosine"))


def _grams_of(word: str) -> list[str]:
    marked = f"<{word}>"
    return sorted({marked[i : i + n] for n in (2, 3) for i in range(max(1, len(marked) - n + 1))})


def concepts_of(words: list[str], known: DataFrame, least: float = LEAST) -> DataFrame:
    """concepts() of a question's words, which are literals: one projection of the known words, without a join."""
    own, hits = F.col("grams"), []
    for w in dict.fromkeys(words):
        g = _grams_of(w)
        sizes = F.size(own).cast("double") * len(g)
        fits = (F.size(own) >= len(g) * least * least - 1e-9) & (F.size(own) <= len(g) / (least * least) + 1e-9)
        common = F.when(fits, F.size(F.array_intersect(own, F.array(*map(F.lit, g))))).otherwise(0)
        cosine = common / F.sqrt(sizes)
        tier = F.when(F.col("word") == w, F.struct(F.lit(0).alias("tier"), F.lit(1.0).alias("strength"))).when(cosine >= least - 1e-12, F.struct(F.lit(1).alias("tier"), cosine.alias("strength")))
        hits.append(F.struct(F.lit(w).alias("asked"), tier.when(T.stem(F.col("word")) == stem_of(w), F.struct(F.lit(2).alias("tier"), F.lit(STEM).alias("strength"))).alias("t")))
    each = known.select("word", grams(F.col("word")).alias("grams")).select(F.col("word").alias("known"), F.inline(F.array(*hits)))
    return each.where("t IS NOT NULL").select("asked", "known", "t.tier", "t.strength")


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """Distinct significant words of texts."""
    return docs.select(F.explode(T.significant_words(F.col(text))).alias("word")).distinct()


def concepts(asked: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """(asked, known, tier, strength): how each known word stands for an asked one. Itself (tier 0, strength 1), by similarity (tier 1, the cosine), by a
    common stem (tier 2); a pair is in its first tier."""
    same = known.join(asked.select("word").distinct(), "word", "left_semi").select(F.col("word").alias("asked"), F.col("word").alias("known"), F.lit(0).alias("tier"), F.lit(1.0).alias("strength"))
    near = pairs(asked, known, least).where("asked <> known").select("asked", "known", F.lit(1).alias("tier"), F.col("cosine").alias("strength"))
    stems = asked.select(F.col("word").alias("asked"), T.stem(F.col("word")).alias("stem")).join(known.select(F.col("word").alias("known"), T.stem(F.col("word")).alias("stem")), "stem").where("asked <> known")
    root = stems.select("asked", "known", F.lit(2).alias("tier"), F.lit(STEM).alias("strength"))
    every = same.unionByName(near).unionByName(root)
    return every.groupBy("asked", "known").agg(F.min("tier").alias("tier"), F.min_by("strength", "tier").alias("strength"))


def strengths(docs: DataFrame, ident: str, text: str, asked: DataFrame | list[str], least: float = LEAST) -> DataFrame:
    """(ident, word, matched, strength) for each text and asked word (a table, or the few words of a question) that it speaks of: literally, else by its most similar word, else by one of the
    word's stem; of equals the first by spelling. Words are compared once each, not once a text."""
    own = docs.select(ident, F.explode(T.significant_words(F.col(text))).alias("known"))
    known = vocabulary(docs, text)
    found = own.join(concepts_of(asked, known, least) if isinstance(asked, list) else concepts(asked, known, least), "known")
    best = F.min(F.struct("tier", (-F.col("strength")).alias("less"), "known"))
    return found.groupBy(ident, F.col("asked").alias("word")).agg(best.alias("b")).select(ident, "word", F.col("b.known").alias("matched"), (-F.col("b.less")).alias("strength"))
