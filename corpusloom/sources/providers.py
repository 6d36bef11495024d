"""What needs a network or a model, behind small interfaces with deterministic offline defaults; and readers of model output."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAN = "struct<geo_location:string,broad_industry:string,search_query:string,result_limit:int,count_explicit:boolean,search_type:string,target_domain:string,intent:string,country_code:string,phone_regex:string,needs_tech_stack:boolean,exclude_keywords:array<string>,include_keywords:array<string>,reasoning:string>"
ROUTES = "struct<selected:array<struct<filename:string,url:string,reason:string,priority:int>>>"


class Embedder(Protocol):
    def embed(self, docs: DataFrame, text: str) -> DataFrame: ...


class Planner(Protocol):
    def plan(self, request: str) -> dict: ...


class Moderator(Protocol):
    def safe(self, request: str) -> bool: ...


class Classifier(Protocol):
    def verdict(self, rows: DataFrame, text: str) -> DataFrame: ...


class MailLookup(Protocol):
    def deliverable(self, rows: DataFrame, domain: str) -> DataFrame: ...


class HashEmbedder:
    """Signed feature hashing of words into `dim` places, unit length. Thresholds made for sentence models mean nothing here."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, docs: DataFrame, text: str) -> DataFrame:
        from ..operators.retrieval import hash_vector

        return docs.withColumn("embedding", hash_vector(F.col(text), self.dim))


class OpenModerator:
    """Lets every request through, as the engine does when moderation fails."""

    def safe(self, request: str) -> bool:
        return True


class GivenVerdicts:
    """Verdicts that stand in a column; a missing one is a match, "unknown" is not."""

    def verdict(self, rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumn("is_lead", F.coalesce(F.lower("relevance_category"), F.lit("match")) == "match")


class TableMailLookup:
    """Deliverability by a dimension table (domain, mx_ok); domains that it lacks stay undecided."""

    def __init__(self, known: DataFrame):
        self.known = known

    def deliverable(self, rows: DataFrame, domain: str) -> DataFrame:
        return rows.join(self.known.select(F.col("domain").alias(domain), "mx_ok"), domain, "left")


def forgiving_json(text: Column, schema: str) -> Column:
    """A JSON value from a text, whole or from its first to its last brace; null if neither parses."""
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.from_json(F.coalesce(ok(text), ok(span)), schema)


def parse_plan(text: Column) -> Column:
    """A request plan from model output, its limit clamped to 1 .. 100."""
    plan = forgiving_json(text, PLAN)
    return F.when(plan.isNotNull(), plan.withField("result_limit", F.least(F.greatest(F.coalesce(plan["result_limit"], F.lit(5)), F.lit(1)), F.lit(100))))


def chosen_routes(answers: DataFrame, candidates: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, url, reason, priority) of chosen pages that are candidates, without repeats, in their order, renumbered."""
    rows = answers.select(ident, F.posexplode(forgiving_json(F.col(text), ROUTES)["selected"]).alias("pos", "r")).select(ident, "pos", F.col("r.url").alias("url"), F.left("r.reason", F.lit(200)).alias("reason"))
    real = rows.join(candidates.select(ident, "url").distinct(), [ident, "url"], "left_semi")
    first = real.groupBy(ident, "url").agg(F.min(F.struct("pos", "reason")).alias("f"))
    from pyspark.sql import Window

    return first.select(ident, "url", F.col("f.reason").alias("reason"), F.row_number().over(Window.partitionBy(ident).orderBy("f.pos")).alias("priority"))


def is_fresh(made: Column, now: Column, days: int, mine: Column, theirs: Column) -> Column:
    """Whether a stored plan still counts: equal signatures, and no older than so many days."""
    return (mine == theirs) & ((F.unix_timestamp(now) - F.unix_timestamp(made)) <= days * 86400)
