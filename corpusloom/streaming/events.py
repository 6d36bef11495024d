"""Structured Streaming over files: windows with watermarks, sessions, deduplication, and retry routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETRYABLE = (429, 500, 502, 503, 504)


def file_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, `files` of them for each micro-batch."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and type; a stream drops what comes later than the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def dedup(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First event of each key; a stream keeps state for the watermark only."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def backoff(attempt: Column, base: float = 1.0, most: float = 20.0) -> Column:
    """Seconds to wait before the next try."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def route(results: DataFrame, least_chars: int = 400, attempts: int = 3) -> DataFrame:
    """Where each fetch result goes: parse, render, retry (with its delay) or failed; each stage counts its own attempts."""
    ok = F.col("status_code").between(200, 299)
    again = (F.col("status_code").isin(*RETRYABLE) | F.col("status_code").isNull()) & (F.col("attempt") < attempts)
    to = F.when(ok & (F.length("html") >= least_chars), "parse").when(ok & (F.col("method") == "http"), "render").when(again, "retry").when(F.col("method") == "http", "render").otherwise("failed")
    return results.withColumn("route", to).withColumn("delay_s", F.when(F.col("route") == "retry", backoff(F.col("attempt"))))


def run_stages(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], checkpoint: str):
    """Route each micro-batch and hand every route's rows to its sink; returns the started query."""

    def batch(df: DataFrame, _: int) -> None:
        routed = route(df).persist()
        for name, sink in sinks.items():
            sink(routed.where(F.col("route") == name))
        routed.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parse(results: DataFrame, html: str = "html") -> DataFrame:
    """The parse stage: adds `page` (see operators.pages). A map over batches that never fails a row: what cannot be parsed is empty."""
    from ..operators.pages import SCHEMA, parsed

    return results.withColumn("page", F.pandas_udf(parsed, SCHEMA)(F.col(html)))


def terminal(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Exactly one terminal event for each key: the first of the kinds done, failed and skipped. A stream remembers keys for the watermark."""
    ends = events.where(F.col("kind").isin("done", "failed", "skipped"))
    if events.isStreaming:
        return ends.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(at, "kind"))
    return ends.withColumn("__r", rank).where("__r = 1").drop("__r")


def complete(events: DataFrame, key: str) -> DataFrame:
    """(key, started, ended): keys by how many terminal events they have; each that was started must have one."""
    return events.groupBy(key).agg(F.count_if(F.col("kind") == "started").alias("started"), F.count_if(F.col("kind").isin("done", "failed", "skipped")).alias("ended"))


def waves(urls: DataFrame, domain: str, order: str, width: int = 3) -> DataFrame:
    """Adds `wave`: at most `width` addresses of a domain are in one wave, which bounds how many are fetched from it at once."""
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(order))
    return urls.withColumn("wave", F.floor((rank - 1) / width).cast("int"))


def revisit(state: DataFrame, results: DataFrame, key: str, most: int = 2) -> DataFrame:
    """Next state (key, fail_count, open) after a round: soft failures are offered again up to `most` times, rejections and successes
    never. `results` has key and outcome (ok, soft, rejected)."""
    joined = state.join(results.groupBy(key).agg(F.max_by("outcome", F.when(F.col("outcome") == "ok", 2).when(F.col("outcome") == "rejected", 1).otherwise(0)).alias("outcome")), key, "left")
    failed = F.col("fail_count") + F.when(F.col("outcome") == "soft", 1).otherwise(0)
    still = F.col("open") & (F.col("outcome").isNull() | ((F.col("outcome") == "soft") & (failed <= most)))
    return joined.select(key, failed.cast("int").alias("fail_count"), still.alias("open"))


def rounds(batches: Callable[[int], DataFrame | None], qualify: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame, int], DataFrame], wanted: int, most: int = 10) -> list[DataFrame]:
    """Discovery rounds until `wanted` rows qualify, rounds run out, or a round has no batch. `keep` writes a round's rows and gives them
    back, so that each round is computed once; only counts come to the driver."""
    out, n = [], 0
    for k in range(most):
        batch = batches(k)
        if batch is None or n >= wanted:
            break
        kept = keep(qualify(batch).limit(wanted - n), k)
        out.append(kept)
        n += kept.count()
    return out
