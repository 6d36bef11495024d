"""Connected components of an edge table by alternating stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """edges has a and b (comparable, not null). Returns node and root (the component's least node) for each node of
    an edge. Rounds grow with the logarithm of the longest path; a hub's neighbours are never in one row."""
    now = C.stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, now = now, C.stash(small.where("a <> b").distinct(), "stars")
        C.drop(old)
        before, mark = mark, _mark(now)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
