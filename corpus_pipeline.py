"""The training-data pipeline over documents: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents; each judges what its predecessor kept.

Defined cases: rows with a null or letterless text go in the first stage; rows are told apart by id and text, so of rows that
repeat an id each is judged by itself, and of equal ones all stay or go together until substring dedup, which cuts the second; null
ids come last; texts of any length are read whole; tables without rows give tables without rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, exact_dedup, jaccard, language_id, packing, substring_dedup
from corpusloom.llm.filters import row_key, without_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language scores less than this stands out in no language.
MIN_LANGUAGE_SCORE = 0.3
#: Near copies: word shingles and similarity.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, texts of no learned language, and texts that stand out in none."""
    seen = language_id.language_id(docs, carry=["text", "lang", "source", "n_chars"])
    return seen.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE) & F.col("learned")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space one stays: the longest, then the smallest id."""
    keyed = docs.select(*COLUMNS, row_key("doc_id", "text").alias("row"))
    return without_ids(keyed, exact_dedup.removed_ids(keyed, id_col="row"), "row").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    num, den = SIMILARITY
    keyed = docs.select(*COLUMNS, row_key("doc_id", "text").alias("row"))
    near = jaccard.jaccard_components(keyed, id_col="row", words=SHINGLE_WORDS, num=num, den=den)
    return without_ids(keyed, near.where("doc_id <> component_id").select("doc_id"), "row").select(COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document (or place) has already; a text of which nothing is left goes."""
    out = substring_dedup.substring_dedup(docs, cut=True, carry=["lang", "source"])
    return out.where("n_removed < n_words").select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("best_fit_packing", pack),
]

#: Language ID is a learned model, which SQL cannot state; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
