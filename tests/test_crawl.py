"""The crawl of all sites against a queue that visits one page after another."""

import random

import pytest

from corpusloom.operators.crawl import crawl


def by_queue(start, edges, has, depth, pages, attempts):
    """Visits of one site: (url, depth, place, kept)."""
    out, queue = [(start, 0, 0, True)], []
    leave = lambda u: sorted((p, k, v) for s, v, p, k in edges if s == u)
    queue += [(v, 1) for _, _, v in leave(start)]
    seen, tried, kept = {start}, 0, 1
    while queue and kept < pages and tried < attempts:
        url, d = queue.pop(0)
        if url in seen or d > depth:
            continue
        seen.add(url)
        tried += 1
        out.append((url, d, tried, has.get(url, False)))
        if has.get(url):
            kept += 1
            queue += [(v, d + 1) for _, _, v in leave(url)] if d < depth else []
    return out


@pytest.mark.parametrize(("seed", "limits"), [(1, (50, 40, 150)), (2, (3, 40, 150)), (3, (50, 6, 150)), (4, (50, 40, 9))])
def test_crawl(spark, seed, limits):
    rng = random.Random(seed)
    start, edges, has, want = [], [], [], {}
    for s in range(6):
        site = None if s == 5 else f"s{s}"
        n = rng.choice([1, 5, 30, 60])
        urls = [f"u{k:02d}" for k in range(n)]
        own = list({(a, b): (a, b, rng.randint(0, 2), rng.randint(0, 9)) for a, b in ((rng.choice(urls), rng.choice([*urls, "gone", "empty"])) for _ in range(3 * n))}.values())
        known = {u: rng.random() < 0.8 for u in urls} | {"empty": False, "u00": True}
        start.append((site, "u00", 1))
        edges += [(site, *e) for e in own] + [(site, "u00", None, 0, 0)]
        has += [(site, u, h) for u, h in known.items()] + [(site, "u00", False)]
        if site:
            want[site] = by_queue("u00", own, known, *limits)
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
    out = crawl(df(start, "site string, url string, depth int"), df(edges, "site string, src string, dst string, priority int, pos int"), df(has, "site string, url string, has boolean"), *limits)
    got = {}
    for r in out.orderBy("site", "place").collect():
        got.setdefault(r.site, []).append((r.url, r.depth, r.place, r.kept))
    assert got == want


def test_no_start(spark):
    none = spark.createDataFrame([], "site string, url string")
    assert crawl(none, spark.createDataFrame([("a", "x", "y", 0, 0)], "site string, src string, dst string, priority int, pos int"), spark.createDataFrame([("a", "x", True)], "site string, url string, has boolean")).collect() == []
