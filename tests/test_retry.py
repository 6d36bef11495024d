"""The staged fetch pipeline: backoff, shared attempts, one end for each URL, restart."""

import time

import pandas as pd

from corpusloom.streaming import retry

PAGE = "<html><body><p>" + "word " * 120 + "</p></body></html>"


def until(done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.5)
    return done()


def rows(spark, path, schema):
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path).collect()
    except Exception:
        return []


def test_steps():
    r = retry.Router()
    assert r.step("http", 0, True, True, False) == ("parse", 0, None)
    assert r.step("http", 0, True, False, False) == ("browser", 0, None)
    assert [r.step("http", k, False, False, True) for k in range(4)] == [("wait", 1, 2.0), ("wait", 2, 4.0), ("wait", 3, 8.0), ("browser", 3, None)]
    assert r.step("http", 0, False, False, False) == ("browser", 0, None)
    assert r.step("browser", 2, False, False, False) == ("wait", 3, 8.0) and r.step("browser", 3, False, False, True) == ("failed", 3, None)
    assert r.step("browser", 1, True, False, False) == ("parse", 1, None)


def test_failed_fetches_come_back_after_their_backoff_and_a_restart(spark, tmp_path):
    jobs, results, pages, log = (str(tmp_path / x) for x in ("jobs", "results", "pages", "log"))
    for x in (jobs, results, log):
        spark.createDataFrame([], retry.JOBS).write.parquet(x) if x != log else (tmp_path / "log").mkdir()

    def fetch(url, method):
        import os
        import time
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{url} {method} {time.time()} {os.getpid()}")
        seen = sum(open(f"{log}/{n}").read().startswith(f"{url} ") for n in os.listdir(log))
        if url == "good":
            return 200, PAGE
        if url == "later":
            return (503, None) if seen < 3 else (200, PAGE)
        if url == "thin":
            return 200, PAGE if method == "browser" else "<p>x</p>"
        raise OSError("no route")

    router = retry.Router(base_s=0.5, most_s=2.0)

    def start():
        stream = lambda path, schema: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
        return [retry.run_fetches(stream(jobs, retry.JOBS), fetch, results, str(tmp_path / "c1"), "200 milliseconds"), retry.run_routes(stream(results, retry.RESULTS), jobs, pages, str(tmp_path / "c2"), router, "200 milliseconds")]

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        spark.createDataFrame([(u, "http", 0) for u in ("good", "later", "thin", "dead")], retry.JOBS).coalesce(1).write.mode("append").parquet(jobs)
        running = start()
        assert until(lambda: any(r.url == "dead" and r.attempt == 1 for r in rows(spark, jobs, retry.JOBS)) or not all(q.isActive for q in running))
        for q in running:  # in the middle of its retries
            q.stop()
        running = start()
        ends = "url string, route string, attempt int"
        assert until(lambda: len(rows(spark, pages, ends)) >= 4 or not all(q.isActive for q in running))
        time.sleep(2)
        for q in running:
            q.stop()
        assert sorted((r.url, r.route, r.attempt) for r in rows(spark, pages, ends)) == [("dead", "failed", 3), ("good", "parse", 0), ("later", "parse", 2), ("thin", "parse", 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset(retry.PROVIDER[0])
    calls = sorted((p.read_text().split() for p in (tmp_path / "log").iterdir()), key=lambda x: float(x[2]))
    at = {u: [float(c[2]) for c in calls if c[0] == u] for u in ("later", "dead")}
    assert [c[1] for c in calls if c[0] == "thin"] == ["http", "browser"]
    assert len(at["later"]) == 3 and at["later"][1] - at["later"][0] >= 1 and at["later"][2] - at["later"][1] >= 2
    assert [c[1] for c in calls if c[0] == "dead"] == ["http"] * 4 + ["browser"]


def test_second_results_change_nothing():
    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Handle:
        timers: list = []

        def getValueState(self, name, schema, ttl):
            return Held()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    r = retry.Router()
    r.init(Handle())
    result = lambda attempt, ok, again, method="http": pd.DataFrame([("u", method, attempt, "h", ok, ok, again)], columns=["url", "method", "attempt", "html", "ok", "enough", "again"])
    feed = lambda x: [tuple(v) for f in r.handleInputRows(("u",), iter([x]), Now()) for v in f[["route", "attempt"]].itertuples(index=False)]
    assert feed(result(0, False, True)) == [("wait", 1)] and Handle.timers == [3000]
    assert feed(result(0, False, True)) == [] and feed(result(1, True, False)) == []  # it is waiting
    assert [f.route[0] for f in r.handleExpiredTimer(("u",), Now(), None)] == ["http"] and list(r.handleExpiredTimer(("u",), Now(), None)) == []
    assert feed(result(1, True, False)) == [("parse", 1)] and feed(result(1, False, True)) == []
