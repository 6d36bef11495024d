"""The registered queries op1 .. op13: thin views of the operators that derive what each contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, exact_dedup, html_text, jaccard, language_id, lexical_search, lm, packing, substring_dedup, vector_codes, vector_search
from . import quality as quality_model
from . import quality_rules as rules

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 18, 1))) AS s, ws FROM w),
keyed AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM win),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM keyed) WHERE rn > 1),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM again, (SELECT unnest(range(0, 20)) AS o)),
left_over AS (SELECT p.doc_id, p.i, p.word, g.i IS NOT NULL AS x FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i),
per AS (SELECT doc_id, count(*) FILTER (WHERE x) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT x), '') AS kept FROM left_over GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN per ON w.doc_id = per.doc_id
"""


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def held_out(id_col: str, fold: int):
    return F.coalesce(common.crc_fold(F.col(id_col)) == fold, F.lit(False)).alias("held_out")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents")).select("doc_id", held_out("doc_id", 0), "lang_pred", "score")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


SQL["op5_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS reached FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(reached) AS low FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = lm.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", held_out("doc_id", 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op11_lexical_search"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(ts)) AS total FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // CAST(total AS BIGINT))))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds as one query: cb0 .. cb4 are the codebooks, a0 .. a4 the assignments by them."""
    nearest = """a{k} AS MATERIALIZED (SELECT vec_id, pos, label, v, min(d) AS d, arg_min(e, (d, e)) AS e
FROM (SELECT x.vec_id, x.pos, x.label, x.v, c.e, CAST(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v) AS BIGINT) AS d FROM x JOIN cb{k} c ON x.pos = c.pos)
GROUP BY vec_id, pos, label, v)"""
    step = """f{n} AS (SELECT pos, e, i, CAST(floor(sum(CAST(y AS BIGINT)) / count(*)) AS DOUBLE) AS y FROM (SELECT pos, e, unnest(v) AS y, unnest(range(len(v))) AS i FROM a{k}) GROUP BY pos, e, i),
cb{n} AS MATERIALIZED (SELECT pos, e, coalesce(any_value(new.v), any_value(old.v)) AS v FROM cb{k} old LEFT JOIN (SELECT pos, e, list(y ORDER BY i) AS v FROM f{n} GROUP BY pos, e) new USING (pos, e) GROUP BY pos, e)"""
    steps = ",\n".join([nearest.format(k=0)] + [step.format(n=n, k=n - 1) + ",\n" + nearest.format(k=n) for n in range(1, rounds + 1)])
    return rf"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, pos, v[pos * len(v) // {parts} + 1:(pos + 1) * len(v) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS pos)),
cb0 AS MATERIALIZED (SELECT pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS BIGINT) AS e, v FROM x QUALIFY e < {entries}),
{steps},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM cb{rounds}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h
"""


SQL["op12_vector_codes"] = _lloyd_sql()


@query
def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
