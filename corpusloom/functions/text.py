"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no keyword signal.
STOPWORDS = (
    "a an the and or but if of at by for with without about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there all any both each few more most other some such no nor not "
    "only own same so than too very can will just should now is are was were be been being have has had having do does did doing "
    "would could you your yours me my i we us our it its this that these those give get find want need please"
).split()
# Words that negate what follows, and phrases that say a thing is not there yet.
NEGATION = r"(^|[^a-z0-9_])(no|not|without|never|none|nor|neither|lack|lacks|lacking)([^a-z0-9_]|$)|n't([^a-z0-9_]|$)"
SOFT_NEGATION = r"in progress|(coming|launching) (soon|later|next [a-z0-9_]+|this [a-z0-9_]+|in [0-9]{4}|spring|summer|fall|autumn|winter)|under (development|construction)|not yet available|not available yet|to be announced|in development"
WINDOW = 40
SUFFIXES = ("ing", "edly", "ed", "es", "s")


def clean(s: Column) -> Column:
    """White space collapsed, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))


def csv_safe(s: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get an apostrophe in front."""
    return F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), s)).otherwise(s)


def shorten(s: Column, width: int = 600) -> Column:
    """White space collapsed, cut to `width` characters with an ellipsis if it is longer."""
    flat = clean(s)
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.left(flat, F.lit(width - 1))), F.lit("…"))).otherwise(flat)


def words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def significant_words(s: Column) -> Column:
    """Distinct words of three letters or more that are no function words, in order."""
    return F.array_distinct(F.filter(words(s), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))


def stem(word: Column) -> Column:
    """The word without the first of a few suffixes that leaves three letters or more."""
    out = word
    for s in reversed(SUFFIXES):
        out = F.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def negated(s: Column, word: str) -> Column:
    """Whether the first whole occurrence of a word (or of a pattern of words) is negated: a negation within 40 characters before it, or a
    "not yet" phrase within 40 after. Null if the word does not occur."""
    low = F.lower(F.coalesce(s, F.lit("")))
    before = F.regexp_extract(low, rf"(?s)^(.*?)(?<![a-z0-9_]){word}(?![a-z0-9_])", 1)
    there = low.rlike(rf"(?<![a-z0-9_]){word}(?![a-z0-9_])")
    start = F.length(before)
    near = F.substring(before, F.greatest(start - (WINDOW - 1), F.lit(1)), F.lit(WINDOW))
    there_len = F.lit(len(word)) if word.isalnum() else F.length(F.regexp_extract(low, rf"(?<![a-z0-9_])({word})(?![a-z0-9_])", 1))
    after = F.substring(low, start + there_len + 1, F.lit(WINDOW))
    return F.when(there, near.rlike(NEGATION) | after.rlike(SOFT_NEGATION))


def reading_minutes(n_words: Column) -> Column:
    """At 225 words a minute, rounded half to even, at least one; 0 without words."""
    return F.when(n_words == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n_words / 225).cast("int")))


def content_key(s: Column) -> Column:
    return F.left(F.sha2(s, 256), F.lit(16))


def signature(s: Column, width: int = 2000) -> Column:
    """The first characters of the text in lower case with white space collapsed: near-exact copies share it."""
    return F.left(F.lower(clean(s)), F.lit(width))


def keyword_hits(s: Column, keywords: list[str]) -> Column:
    """Keywords that the text contains as substrings, in any case."""
    low = F.lower(F.coalesce(s, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords]))


def visible(html: Column) -> Column:
    """Rough visible text of raw HTML: scripts, styles and tags out, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    return clean(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
