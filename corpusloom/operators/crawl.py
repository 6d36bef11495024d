"""A site crawl over known links, all sites at once: semi-naive rounds with the limits of each site as state.

A site's visit is a queue: a page's links join its end in order of contact priority and place; a page met again is passed over. Page order is thus
the order of (depth, place of the first page that links to it, priority, place of the link), so a round can take a whole depth of all sites: new pages are
ranked within their site, and a site goes on as long as it has visits and pages left. A round writes what it visited (a delta); later rounds join links to the last
delta only, and state is an aggregate of deltas, which hold at most `attempts` + 1 rows of a site. Lists of any size are cut by rank before they are shuffled for ranking.

Defined cases: a page that is not known, or known without content, is a visit but no page, and leads nowhere; rows that repeat a page count once (with content if one has); null sites
or addresses take no part; a site without a start has no visit.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

DEPTH, PAGES, ATTEMPTS = 50, 40, 150
VISIT = ["site", "url", "depth", "place", "kept"]


def _of_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known, ["site", "url"], "left").withColumn("kept", F.coalesce("has", F.lit(False))).drop("has")


def crawl(start: DataFrame, edges: DataFrame, fetched: DataFrame, depth: int = DEPTH, pages: int = PAGES, attempts: int = ATTEMPTS) -> DataFrame:
    """(site, url, depth, place, kept): the visits of each site in order; the start page has place 0 and costs no attempt. `start` has (site, url), `edges`
    (site, src, dst, priority, pos), `fetched` (site, url, has): whether fetching gives content."""
    known = written(fetched.where("site IS NOT NULL AND url IS NOT NULL").groupBy("site", "url").agg(F.max("has").alias("has")), "fetched")
    first = start.where("site IS NOT NULL AND url IS NOT NULL").groupBy("site").agg(F.min("url").alias("url"))
    home = _of_known(first, known).select("site", "url", F.lit(0).alias("depth"), F.lit(0).alias("place"), F.lit(True).alias("kept"))
    links = written(edges.where("site IS NOT NULL AND dst IS NOT NULL").select("site", F.col("src").alias("from"), "dst", "priority", "pos"), "links")
    deltas = [written(home, "visits")]
    for level in range(1, depth + 1):
        seen = functools.reduce(DataFrame.unionAll, deltas)
        state = seen.groupBy("site").agg(F.count_if("kept").alias("have"), F.max("place").alias("used"))
        live = state.where((F.col("have") < pages) & (F.col("used") < attempts))
        front = deltas[-1].where("kept").join(live.select("site"), "site", "left_semi").select("site", F.col("url").alias("from"), F.col("place").alias("parent"))
        met = front.join(links, ["site", "from"]).groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("parent", "priority", "pos")).alias("at"))
        new = met.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        ranked = new.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("at", "url"))).where(F.col("rank") <= attempts)
        tried = _of_known(ranked.join(live, "site").where(F.col("used") + F.col("rank") <= attempts), known)
        before = F.coalesce(F.sum(F.col("kept").cast("int")).over(Window.partitionBy("site").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        went = tried.withColumn("before", before).where(F.col("have") + F.col("before") < pages)
        delta = written(went.select("site", "url", F.lit(level).alias("depth"), (F.col("used") + F.col("rank")).alias("place"), "kept"), "visits")
        if delta.isEmpty():
            break
        deltas.append(delta)
    return functools.reduce(DataFrame.unionAll, deltas).select(VISIT)
