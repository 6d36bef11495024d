"""Readers and writers: the crawl index, page texts, link graphs, JSON documents, exports, and keyed tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from ..operators.retrieval import upsert

INDEX_COLUMNS = "company_name domain website_url page_url page_title meta_description email phone_number physical_address txt_path crawl_status http_status content_length word_count timestamp page_type relevance_category relevance_reason validated_industry validated_geo".split()
INDEX = T.StructType([T.StructField(c, T.StringType()) for c in INDEX_COLUMNS])
LINKS = T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor", T.StringType())])))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The crawl index: every cell a string, unknown columns dropped, missing ones and nulls empty."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[(F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")).alias(c) for c in INDEX_COLUMNS])


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of each text file."""
    return spark.read.option("wholetext", True).text(folder, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_links(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, anchor) edges of link-graph documents; bad JSON has none."""
    raw = spark.read.option("wholetext", True).text(folder, recursiveFileLookup=True)
    graph = raw.select(F.explode(F.from_json("value", LINKS)).alias("src", "links"))
    return graph.select("src", F.inline("links")).toDF("src", "dst", "anchor")


def read_source_docs(spark: SparkSession, path: str) -> DataFrame:
    """(url, title, content) from either column vocabulary, without empty contents."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns], F.lit(""))
    return raw.select(pick("url", "page_url").alias("url"), pick("title", "page_title").alias("title"), pick("content", "page_text").alias("content")).where(F.trim("content") != "")


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A small JSON document; malformed fields are null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def sitemap_urls(rows: DataFrame, xml: str) -> DataFrame:
    """URLs of sitemap texts."""
    return rows.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))


def write_export(df: DataFrame, path: str) -> None:
    """CSV in which no cell runs as a formula."""
    df.select(*[X.csv_safe(F.col(c).cast("string")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, structured: dict[str, str] | None = None) -> None:
    """JSON lines; columns of JSON text named in `structured` (with their schemas) are written as values."""
    for c, schema in (structured or {}).items():
        df = df.withColumn(c, F.from_json(c, schema))
    df.write.mode("overwrite").json(path)


def write_quarantine(pages: DataFrame, sites: DataFrame, path: str) -> None:
    """Rejected pages and sites in one layout: level, reason, company_name, website_url, detail."""
    cols = ["level", "reason", "company_name", "website_url", "detail"]
    pages.withColumn("level", F.lit("page")).select(cols).unionByName(sites.withColumn("level", F.lit("business")).select(cols)).write.mode("overwrite").option("header", True).csv(path)


def write_domains(df: DataFrame, path: str) -> None:
    """Commit whole sites: partitions of the domains in df are replaced, others stay; nothing is appended twice."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)


def stage_pages(pages: DataFrame, path: str, run: str) -> None:
    """Add pages to a run's staging area, one folder for each domain; nothing there is visible to readers of the table."""
    pages.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "domain").parquet(f"{path}/_staging")


def staged(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_staging").where(F.col("run") == run).drop("run")


def commit_staged(spark: SparkSession, path: str, run: str, domains: DataFrame | None = None) -> None:
    """Move a run's staged pages of some domains (all by default) into the table: their partitions are replaced whole."""
    rows = staged(spark, path, run)
    write_domains(rows if domains is None else rows.join(domains.select("domain").distinct(), "domain", "left_semi"), f"{path}/pages")
    discard_staged(spark, path, run)


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard_staged(spark: SparkSession, path: str, run: str, domain: str | None = None) -> bool:
    """Drop what a run has staged, for one domain or all; false if there is nothing."""
    return _delete(spark, f"{path}/_staging/run={run}" + (f"/domain={domain}" if domain else ""))


def clean_orphans(spark: SparkSession, path: str, alive: list[str]) -> list[str]:
    """Drop the staging areas of runs that are no longer alive; returns their names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_staging")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    gone = sorted(n.removeprefix("run=") for n in names if n.startswith("run=") and n.removeprefix("run=") not in alive)
    for run in gone:
        _delete(spark, f"{path}/_staging/run={run}")
    return gone


def append_rows(df: DataFrame, path: str) -> None:
    """Append index rows in the index's column order; columns that it does not know are left out, missing ones are empty."""
    df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in INDEX_COLUMNS]).write.mode("append").option("header", True).option("escape", '"').csv(path)


def retire(spark: SparkSession, path: str, gone: DataFrame, key: str, to: str) -> None:
    """The table without some keys, to a new place."""
    spark.read.parquet(path).join(gone.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(to)


def merge_into(spark: SparkSession, path: str, new: DataFrame, key: str, to: str) -> None:
    """Upsert by key, to a new place."""
    upsert(spark.read.parquet(path), new, key).write.mode("overwrite").parquet(to)


def report(stats: DataFrame, rows: DataFrame, most: int = 10) -> str:
    """A text report of one-row statistics and the first rows."""
    lines = [f"{k}: {v}" for k, v in stats.first().asDict().items()]
    return "\n".join([*lines, "", *[" | ".join("" if x is None else str(x) for x in r) for r in rows.limit(most).collect()]])


class PagedSearch(DataSource):
    """A data source over a paged search provider: pass `pages` and a provider registered in PROVIDERS by name."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "query string, page int, position int, url string, title string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(1, int(self.options.get("pages", "1")) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        query = self.options.get("query", "")
        for k, (url, title) in enumerate(PROVIDERS[self.options.get("provider", "offline")](query, partition.value)):
            yield query, partition.value, k, url, title


#: Search providers by name; the offline one finds nothing.
PROVIDERS = {"offline": lambda query, page: []}
