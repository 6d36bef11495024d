"""A vector index on disk: inverted lists as partitions, one-byte residual codes, exact re-ranking, upsert and delete.

A vector's list is its nearest centroid; the table is partitioned by list, so a search reads the folders of the lists it probes and no others. It reads the codes
first (a byte for each dimension: the unit vector less its centroid, in 255 steps) and how far each vector lies from its code. That bounds every score from both sides, so
of each question's rows all stay whose upper bound reaches the k-th best lower bound, and only their vectors are fetched for the exact cosine: the answer is the exact one among
the lists probed, however close the scores are. Questions are few and come from the driver in blocks of QUESTIONS; rows are scored where they are read, in batches, so no list
is ever gathered in one task. Changes rewrite the lists they touch.

Defined cases: null or zero vectors and those of another length are left out; ids are unique within the index (the last of a batch of changes wins: the greatest vector); unknown ids
are deleted without effect; an index without rows answers with no rows; scores equal to DIGITS places go by id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

LIST, LISTS, SAMPLE, QUESTIONS, DIGITS = 1000, 4096, 64, 1024, 9
#: What single precision and rounding to DIGITS places can add to a bound.
SLACK = 1e-5


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _means(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of a sample of unit vectors, by cosine."""
    c = sample[np.random.default_rng(k).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        for j in np.unique(near):
            total = sample[near == j].sum(axis=0)
            if (size := np.sqrt(total @ total)) > 1e-9:
                c[j] = total / size
    return c


class VectorIndex:
    """An index in a folder. `keep` names the columns stored beside id and vector, by which searches may filter."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = json.loads(spark.read.option("wholetext", True).text(f"{path}/meta").first()["value"])
        self.centroids, self.step = np.array(meta["centroids"]).reshape(-1, meta["width"]), meta["step"]
        self.ident, self.vector, self.keep = meta["ident"], meta["vector"], meta["keep"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, ident: str, vector: str, keep: Sequence[str] = (), lists: int | None = None) -> VectorIndex:
        spark = vectors.sparkSession
        rows = cls._sound(vectors.select(ident, vector, *keep), vector)
        n = rows.count()
        k = max(1, min(LISTS, n // LIST if lists is None else lists))
        sample = [r[0] for r in rows.orderBy(F.xxhash64(ident)).limit(k * SAMPLE).select(vector).collect()]  # bounded by LISTS * SAMPLE rows
        width = len(sample[0]) if sample else 1
        drawn = _unit(np.array([x for x in sample if len(x) == width], np.float64)) if sample else np.ones((1, 1))
        c = _means(drawn, min(k, len(drawn)))
        step = float(np.abs(drawn - c[(drawn @ c.T).argmax(axis=1)]).max()) / 127 or 1.0
        meta = {"centroids": c.ravel().tolist(), "width": width, "step": step, "ident": ident, "vector": vector, "keep": list(keep)}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        self = cls(spark, path)
        self._coded(rows).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        return self

    @staticmethod
    def _sound(rows: DataFrame, vector: str) -> DataFrame:
        return rows.where(F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def rows(self) -> DataFrame:
        """All stored rows: id, vector, kept columns, code, off (distance of the unit vector from its code), list."""
        return self.spark.read.parquet(f"{self.path}/lists")

    def count(self) -> int:
        return self.rows().count()

    def _coded(self, rows: DataFrame) -> DataFrame:
        c, step, width, vector = self.centroids, self.step, self.width, self.vector

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _unit(_matrix(b[vector], width))
                near = (x @ c.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
                codes = np.clip(np.rint((x - c[near]) / step), -127, 127).astype(np.int8)
                left = x - c[near] - codes * step
                off = np.sqrt((left * left).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(off, pa.float64()), pa.array(near.astype(np.int32))], names=[*b.schema.names, "code", "off", "list"])

        fit = self._sound(rows, vector).where(F.size(vector) == width)
        return fit.mapInArrow(code, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fit.schema)}, code binary, off double, list int")

    def probed(self, questions: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each question."""
        return np.argsort(-(_unit(questions) @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def read(self, lists: Sequence[int], where: Column | None = None) -> DataFrame:
        """The rows of some lists: the scan reads their folders only."""
        rows = self.rows().where(F.col("list").isin([int(x) for x in lists]))
        return rows if where is None else rows.where(where)

    def search(self, questions: Sequence[Sequence[float]], k: int = 10, probes: int = 8, where: Column | None = None) -> DataFrame:
        """(question, rank, id, similarity): the k nearest found for each question, which is named by its place."""
        id_type = self.rows().schema[self.ident].dataType.simpleString()
        out = self.spark.createDataFrame([], f"question int, rank int, `{self.ident}` {id_type}, similarity double")
        for first in range(0, len(questions), QUESTIONS):
            out = out.unionAll(self._block(np.array(questions[first : first + QUESTIONS], np.float64), first, k, probes, where, id_type))
        return out

    def _block(self, questions: np.ndarray, first: int, k: int, probes: int, where: Column | None, id_type: str) -> DataFrame:
        q, lists, c, step, ident, vector, width = _unit(questions), self.probed(questions, probes), self.centroids, self.step, self.ident, self.vector, self.width
        base = q @ c.T
        asks = {int(x): np.flatnonzero((lists == x).any(axis=1)) for x in np.unique(lists)}

        def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Bounds of the scores; of a batch's rows those that k others of it do not surely beat."""
            for b in batches:
                of, code, off = b["list"].to_numpy(), np.frombuffer(b"".join(b["code"].to_pylist()), np.int8).reshape(-1, width), b["off"].to_numpy()
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
                for x in np.unique(of):
                    at, who = np.flatnonzero(of == x), asks[int(x)]
                    score = (code[at].astype(np.float32) @ q[who].T.astype(np.float32)).T.astype(np.float64) * step + base[who, x][:, None]
                    low, high = score - off[at] - SLACK, score + off[at] + SLACK
                    least = np.partition(low, -k, axis=1)[:, -k] if len(at) > k else np.full(len(who), -np.inf)
                    mine, row = np.nonzero(high >= least[:, None])
                    found.append((who[mine], at[row], low[mine, row], high[mine, row]))
                who, at, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), b[ident].take(pa.array(at)), pa.array(of[at].astype(np.int32)), pa.array(low), pa.array(high)], names=["question", "id", "list", "low", "high"])

        pool = self.read(list(asks), where)
        guess = written(pool.select(ident, "code", "off", "list").mapInArrow(rough, f"question int, id {id_type}, list int, low double, high double"), "bounds")
        best = guess.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("low")))).where(F.col("n") <= k)
        floor = best.where(F.col("n") == k).select("question", F.col("low").alias("floor"))  # at most QUESTIONS rows; none of questions with fewer rows
        held = guess.join(F.broadcast(floor), "question", "left").where("floor IS NULL OR high >= floor").select("question", F.col("id").alias(ident), "list")
        full = pool.select(ident, "list", vector).join(held, ["list", ident]).select("question", ident, vector)

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                who = b["question"].to_numpy()
                score = np.einsum("ij,ij->i", _unit(_matrix(b[vector], width)), q[who]) if len(who) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(who + np.int32(first)), b[ident], pa.array(score)], names=["question", ident, "similarity"])

        scored = full.mapInArrow(exact, f"question int, `{ident}` {id_type}, similarity double")
        rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.round("similarity", DIGITS)), ident))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("question", "rank", ident, "similarity")

    def _rewrite(self, gone: DataFrame, new: DataFrame | None) -> None:
        """The lists that hold ids of `gone` or get rows of `new`, without the former and with the latter."""
        old = self.rows()
        ids = gone.select(self.ident).where(F.col(self.ident).isNotNull()).distinct()
        touched = {r["list"] for r in old.select(self.ident, "list").join(ids, self.ident, "left_semi").select("list").distinct().collect()}
        touched |= {r["list"] for r in new.select("list").distinct().collect()} if new is not None else set()  # at most LISTS numbers
        if not touched:
            return
        left = self.read(sorted(touched)).join(ids, self.ident, "left_anti")
        after = written(left if new is None else left.select(new.columns).unionByName(new), "lists")
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.path}/lists")
        for empty in touched - {r["list"] for r in after.select("list").distinct().collect()}:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists/list={empty}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.spark.catalog.refreshByPath(f"{self.path}/lists")

    def upsert(self, rows: DataFrame) -> None:
        """Rows in place of those of their ids; a row whose vector has moved changes its list."""
        slim = rows.select(self.ident, self.vector, *self.keep)
        once = slim.groupBy(self.ident).agg(F.max(F.struct(self.vector, *self.keep)).alias("r")).select(self.ident, "r.*")
        self._rewrite(slim, written(self._coded(once), "coded"))

    def delete(self, ids: DataFrame) -> None:
        self._rewrite(ids, None)
