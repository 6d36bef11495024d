"""The staged fetch pipeline as streams with state: a failed fetch comes back after its backoff, by a processing-time timer of its URL.

Queues are tables. A fetch stream reads jobs and writes results; a route stream reads results, keeps each URL's stage and number of
attempts as state, and gives out what comes next: `parse` and `failed` are final, `http` and `browser` are jobs to fetch, `wait` says
that one is due later. A restart from the checkpoint has the same state and timers, so no job is lost and none ends twice.

Defined cases: a URL ends once; results that come after its end, and second results of one attempt, change nothing. State is forgotten `keep` after its last
change. Both stages share the attempts of a job. Null URLs are one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules as R
from ..functions import text as T
from .events import RETRYABLE, parse

ROUTED = "url string, route string, attempt int, delay_s double, html string"
JOBS = "url string, method string, attempt int"
RESULTS = "url string, method string, attempt int, status_code int, html string"
ATTEMPTS, BASE_S, MOST_S = 3, 1.0, 20.0
KEEP_MS = 24 * 3600 * 1000
#: What state needs: timers live in RocksDB.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Router(StatefulProcessor):
    """One job for each URL: (stage, attempt, ended)."""

    def __init__(self, attempts: int = ATTEMPTS, base_s: float = BASE_S, most_s: float = MOST_S, keep_ms: int = KEEP_MS):
        self.attempts, self.base_s, self.most_s, self.keep_ms = attempts, base_s, most_s, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "stage string, attempt int, waiting boolean, ended boolean", self.keep_ms)

    def step(self, stage: str, attempt: int, ok: bool, enough: bool, again: bool) -> tuple[str, int, float | None]:
        """(route, attempt, delay) after a result of a stage."""
        if ok and (enough or stage == "browser"):
            return "parse", attempt, None
        if not ok and (again or stage == "browser") and attempt < self.attempts:
            return "wait", attempt + 1, min(self.base_s * 2 ** (attempt + 1), self.most_s)
        return ("browser" if stage == "http" else "failed"), attempt, None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        stage, attempt, waiting, ended = self.job.get() if self.job.exists() else ("http", 0, False, False)
        for batch in rows:
            for r in batch.sort_values("attempt", kind="stable").itertuples():
                if ended or waiting or r.method != stage or r.attempt != attempt:
                    continue
                route, attempt, delay = self.step(stage, attempt, r.ok, r.enough, r.again)
                stage = "browser" if route == "browser" else stage
                waiting, ended = route == "wait", route in ("parse", "failed")
                if waiting:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(delay * 1000))
                out.append((key[0], route, attempt, delay, r.html if ended else None))
        self.job.update((stage, attempt, waiting, ended))
        yield pd.DataFrame(out, columns=["url", "route", "attempt", "delay_s", "html"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stage, attempt, waiting, ended = self.job.get() if self.job.exists() else ("http", 0, False, True)
        if waiting and not ended:
            self.job.update((stage, attempt, False, False))
            yield pd.DataFrame([(key[0], stage, attempt, None, None)], columns=["url", "route", "attempt", "delay_s", "html"])


def judged(results: DataFrame) -> DataFrame:
    """Results with what the router asks: fetched, enough text, worth another try."""
    enough: Column = R.sufficiency(F.col("html"), T.visible(F.col("html"))) == "ok"
    code = F.col("status_code")
    return results.select("url", "method", "attempt", "html", F.coalesce(code.between(200, 299), F.lit(False)).alias("ok"), F.coalesce(enough, F.lit(False)).alias("enough"), (code.isNull() | code.isin(*RETRYABLE)).alias("again"))


def routed(results: DataFrame, router: Router | None = None) -> DataFrame:
    """The stream of what comes next for each URL."""
    results.sparkSession.conf.set(*PROVIDER)
    return judged(results).groupBy("url").transformWithStateInPandas(router or Router(), ROUTED, "Append", "processingTime")


def run_routes(results: DataFrame, jobs: str, pages: str, checkpoint: str, router: Router | None = None, every: str = "1 second"):
    """Starts the route stream: jobs to fetch go to the table `jobs`, ended ones, parsed, to `pages` (failed ones with empty parts). A batch that is
    run again after a failure replaces its own rows. Returns the query."""

    def batch(df: DataFrame, number: int) -> None:
        held = df.persist()
        again = held.where(F.col("route").isin("http", "browser")).select("url", F.col("route").alias("method"), "attempt")
        ended = parse(held.where(F.col("route").isin("parse", "failed"))).drop("html", "delay_s")
        for rows, path in ((again, jobs), (ended, pages)):
            if not rows.isEmpty():
                rows.write.mode("overwrite").parquet(f"{path}/route={number:09d}")
        held.unpersist()

    return routed(results, router).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def run_fetches(jobs: DataFrame, fetch: Callable[[str, str], tuple[int | None, str | None]], results: str, checkpoint: str, every: str = "1 second"):
    """Starts the fetch stream: `fetch(url, method)` gives (status code, html) of each job; what it raises is a failed connection (no code)."""

    def one(url, method):
        try:
            return fetch(url, method)
        except Exception:  # a job ends as failed, never the stream
            return None, None

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(u, m, a, *one(u, m)) for u, m, a in b[["url", "method", "attempt"]].itertuples(index=False)]
            frame = pd.DataFrame(got, columns=["url", "method", "attempt", "status_code", "html"])
            yield frame.astype({"status_code": "Int32"})

    return jobs.mapInPandas(fetched, RESULTS).writeStream.format("parquet").option("path", results).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
