"""Quality rules: a learned decision list over text statistics, in DataFrame and SQL expressions only.

The statistics of every whole text are column expressions. Sequential covering learns from labelled texts: grow a
conjunction of thresholds on two thirds of the rows (FOIL gain), prune it on the rest, emit it, drop what it covers,
go on. The list becomes one ordered chain of CASE WHEN conditions, which Spark evaluates with the statistics.

Learned from a bounded sample of SAMPLE labelled rows (smallest hashes of ids), whose statistics alone reach the driver.

Defined cases: null texts count as empty (no words: base_failed); a text without labels or an empty label table leaves an empty
list, which keeps all that the base rules keep; rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, MAX_RULES, MAX_TERMS, MIN_COVER, MIN_PRECISION = 4096, 8, 3, 8, 0.9
MIN_WORDS = 50
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "dup_line_share", "repeat_share")


def _fixed(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns behind a generator of one row, so that the optimiser neither pushes conditions below them nor
    copies them into the lambdas that use them (where they would run once for each element)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], F.inline(F.array(F.struct(*[c.alias(k) for k, c in new.items()]))))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of each whole text under their own names; a column of docs with such a name is replaced."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gaps, signs = "\\t\\n\\x0b\\f\\r ".encode().decode("unicode_escape"), "#*$%&|<>"
    solid = F.char_length(F.translate(text, gaps, ""))
    first = _fixed(
        docs,
        {
            "__words": F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)),
            "__lines": F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, gaps, "") != ""),
            "word_chars": solid.cast("bigint"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, signs, ""))).cast("bigint"),
            "__upper": (F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint"),
        },
    )
    words = F.col("__words")
    inner = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    hashed = _fixed(
        first,
        {
            "n_words": F.size(words).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "__n_lines": F.size("__lines"),
            "__windows": F.sort_array(F.transform(inner, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))),
        },
    ).drop("__words", "__lines")
    win = F.col("__windows")
    twice = F.filter(win, lambda x, k: F.coalesce(F.get(win, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(win, k + 1)["h"] == x["h"], F.lit(False)))
    placed = _fixed(hashed, {"__at": F.sort_array(F.transform(twice, lambda x: x["i"]))}).drop("__windows")
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    many = F.greatest(F.col("n_words"), F.lit(1))
    return _fixed(placed, {"n_repeat_words": covered}).drop("__at").withColumns(
        {
            "mean_word": F.col("word_chars") / many,
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "upper_share": F.col("__upper") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / many,
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
        }
    ).drop("__upper", "__n_lines")


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    bound: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.bound) == self.above

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


def _best_term(rows: list[tuple[dict, int]]) -> Term | None:
    """The threshold with the highest FOIL gain for bad rows (label 0); one pass over each feature's sorted values."""
    bad = sum(y == 0 for _, y in rows)
    if not bad or bad == len(rows):
        return None
    base, best, found = math.log2(bad / len(rows)), 0.0, None
    for f in FEATURES:
        ranked = sorted((x[f], y) for x, y in rows)
        below, n = 0, 0
        for k in range(len(ranked) - 1):
            below += ranked[k][1] == 0
            n += 1
            if ranked[k][0] == ranked[k + 1][0]:
                continue
            bound = (ranked[k][0] + ranked[k + 1][0]) / 2
            for above, p, m in ((False, below, n), (True, bad - below, len(rows) - n)):
                if p and m >= MIN_COVER and (gain := p * (math.log2(p / m) - base)) > best + 1e-12:
                    best, found = gain, Term(f, above, bound)
    return found


def _precision(terms: list[Term], rows: list[tuple[dict, int]]) -> tuple[float, int]:
    hit = [y for x, y in rows if all(t.holds(x) for t in terms)]
    return (sum(y == 0 for y in hit) + 0.5) / (len(hit) + 1), len(hit)


def learn(rows: list[tuple[dict, int]]) -> list[tuple[Term, ...]]:
    """An ordered list of conjunctions, each of which marks texts of label 0."""
    grow, prune = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if k % 3 == 0]
    rules: list[tuple[Term, ...]] = []
    while len(rules) < MAX_RULES:
        terms, left = [], grow
        while len(terms) < MAX_TERMS and (t := _best_term(left)):
            terms.append(t)
            left = [r for r in left if t.holds(r[0])]
        while len(terms) > 1:  # drop terms while that does not hurt on the rows kept apart
            shorter = max(([t for t in terms if t is not x] for x in terms), key=lambda ts: _precision(ts, prune)[0])
            if _precision(shorter, prune)[0] < _precision(terms, prune)[0]:
                break
            terms = shorter
        if not terms or _precision(terms, grow)[0] < MIN_PRECISION or _precision(terms, prune)[0] < MIN_PRECISION - 0.1 or _precision(terms, grow)[1] < MIN_COVER:
            break
        rules.append(tuple(terms))
        grow = [r for r in grow if not all(t.holds(r[0]) for t in terms)]
        prune = [r for r in prune if not all(t.holds(r[0]) for t in terms)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[Term, ...]]:
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("__k"), F.col(label_col).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__k"), "__k", "__y").limit(SAMPLE)
    )
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__id") == F.col("__k"))
    stats = with_statistics(slim, "__text").where(~F.col("base_failed"))  # the list judges what the base rules keep
    got = stats.select("__id", "__y", *FEATURES).collect()
    got.sort(key=lambda r: (str(r["__id"])[::-1], r["__y"]))
    return learn([({f: float(r[f]) for f in FEATURES}, r["__y"]) for r in got])


def verdict(rules: list[tuple[Term, ...]]) -> tuple[Column, Column]:
    """(kept, the rule that decides) as ordered conditional expressions over the statistics."""
    kept, rule = F.when(F.col("base_failed"), False), F.when(F.col("base_failed"), "base")
    for terms in rules:
        cond = terms[0].column()
        for t in terms[1:]:
            cond = cond & t.column()
        kept, rule = kept.when(cond, False), rule.when(cond, " and ".join(map(str, terms)))
    return kept.otherwise(True), rule


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Returns doc_id, the statistics, base_failed, kept, and the rule that dropped the text (null if none)."""
    rules = fit(docs, labels, id_col, text_col, label_col)
    kept, rule = verdict(rules)
    stats = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), "__text").drop("__text")
    return stats.withColumn("kept", kept).withColumn("rule", rule)
