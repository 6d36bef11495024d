"""Registered queries of search: words that look alike, and how texts match them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import similar
from ..operators.vector_index import VectorIndex
from ..session import table
from ..sources.scratch import folder
from .catalog import _WORDS, _in, query

_SIGNIFICANT = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN {_in(T.STOPWORDS)}))"
_GRAMS = "list_distinct(list_concat(list_transform(range(1, len(w) + 2), lambda i: substring('<' || w || '>', i, 2)), list_transform(range(1, len(w) + 1), lambda i: substring('<' || w || '>', i, 3))))"
#: The similarity join as SQL: count common grams of all pairs that have one. Needs tables asked(w) and known(w).
_SIMILAR = f"""
ga AS (SELECT w, len(g) AS n, unnest(g) AS g FROM (SELECT w, {_GRAMS} AS g FROM asked)), gk AS (SELECT w, len(g) AS n, unnest(g) AS g FROM (SELECT w, {_GRAMS} AS g FROM known)),
near AS (SELECT a.w AS asked, k.w AS known, count(*) / sqrt(CAST(any_value(a.n) * any_value(k.n) AS DOUBLE)) AS cosine FROM ga a JOIN gk k ON a.g = k.g GROUP BY 1, 2 HAVING 25 * count(*) * count(*) >= 9 * any_value(a.n) * any_value(k.n))"""


@query(f"WITH asked AS (SELECT DISTINCT unnest({_SIGNIFICANT}) AS w FROM benchmark), known AS (SELECT DISTINCT unnest({_SIGNIFICANT}) AS w FROM documents),{_SIMILAR} SELECT asked, known, round(cosine, 6) AS cosine FROM near WHERE asked <> known")
def q_similar_words(spark, d):
    """Words of documents that look like a word of a benchmark passage."""
    asked, known = (similar.vocabulary(table(spark, d, t), "text") for t in ("benchmark", "documents"))
    return similar.pairs(asked, known).where("asked <> known").select("asked", "known", F.round("cosine", 6).alias("cosine"))


def _stem(w: str) -> str:
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{z}' AND length({w}) >= {len(z) + 3} THEN left({w}, length({w}) - {len(z)})" for z in T.SUFFIXES) + f" ELSE {w} END"


_ASKED = [*_WORDS, "liberty", "sources"]


@query(f"""WITH asked AS (SELECT unnest([{", ".join(f"'{w}'" for w in _ASKED)}]) AS w), own AS (SELECT doc_id, unnest({_SIGNIFICANT}) AS w FROM documents), known AS (SELECT DISTINCT w FROM own),{_SIMILAR},
c AS (SELECT w AS asked, w AS known, 0 AS tier, 1.0 AS s FROM known WHERE w IN (SELECT w FROM asked) UNION ALL SELECT asked, known, 1, cosine FROM near WHERE asked <> known
  UNION ALL SELECT a.w, k.w, 2, 0.9 FROM asked a JOIN known k ON {_stem("a.w")} = {_stem("k.w")} AND a.w <> k.w),
r AS (SELECT doc_id, asked, known, s, row_number() OVER (PARTITION BY doc_id, asked ORDER BY tier, s DESC, known) AS rn FROM own JOIN c ON own.w = c.known)
SELECT doc_id, asked AS word, known AS matched, round(CAST(s AS DOUBLE), 6) AS strength FROM r WHERE rn = 1""")
def q_fuzzy_strengths(spark, d):
    """How strongly each document speaks of each word of a question, and by which word."""
    return similar.strengths(table(spark, d, "documents"), "doc_id", "text", _ASKED).select("doc_id", "word", "matched", F.round("strength", 6).alias("strength"))


_UNIT = "list_transform(embedding, lambda c: CAST(c AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"


@query(f"""WITH v AS (SELECT vec_id, {_UNIT} AS u FROM embeddings), q AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS question, u FROM v ORDER BY vec_id LIMIT 10),
s AS (SELECT question, vec_id, round(list_dot_product(q.u, v.u), 9) AS similarity FROM q, v)
SELECT question, CAST(rank AS INTEGER) AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def q_vector_index(spark, d):
    """The nearest of all vectors to the ten first, from an index of all of them in which every list is probed."""
    rows = table(spark, d, "embeddings")
    index = VectorIndex.build(rows, f"{folder(spark)}/scratch/index-{uuid.uuid4().hex}", "vec_id", "embedding", ["label"], lists=8)
    questions = [r["embedding"] for r in rows.orderBy("vec_id").limit(10).collect()]
    return index.search(questions, 10, probes=8).withColumn("similarity", F.round("similarity", 9))
