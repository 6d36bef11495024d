"""Compression of vectors to codes: product quantisation learned on distinct integer parts.

Vectors become integers, floor(1024 * x), and are cut into PARTS consecutive parts. Equal parts of a position are one
weighted row, counted by Spark with map-side combination. Weighted Lloyd rounds run over these distinct rows: tasks assign them to the
codebook's nearest entries and return sums and weights of each entry, which Spark adds up; the driver holds the codebooks (PARTS * ENTRIES rows,
whatever the input). Codes and errors of the distinct parts are then joined back to the vectors. Parts that more than one in HEAVY rows of
their position has (so at most HEAVY of them) are joined by broadcast, so a very common vector makes no large task; all others by a plain join.
All sums and distances are whole numbers, so neither the order of rows nor the number of tasks changes a result.

Defined cases: rows with a null vector, null or non-finite components, no components, or another length than most vectors have are dropped; a length that four does
not divide is cut at floor(p * length / 4); components saturate at +-2**23 (values of +-8192), so that sums fit in 64 bits; rows that repeat a
vec_id all count, and start codebooks in the order of their components; null ids come last; null labels are one label; fewer rows than
entries give smaller codebooks; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .vectors import dimension, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 23
HEAVY = 512
#: Rows whose distances are held at once.
STEP = 2048


def part_columns(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index; all in whole numbers."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if 4 * int(most) ** 2 * max(1, x.shape[1]) < 1 << 53 else np.int64
    entries = book.astype(kind)
    own, code, far = (entries * entries).sum(axis=1), np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), STEP):
        rows = x[i : i + STEP].astype(kind)
        d = own - 2 * (rows @ entries.T)  # the row's own square is the same for all entries
        c = d.argmin(axis=1)
        code[i : i + STEP] = c
        far[i : i + STEP] = d[np.arange(len(c)), c] + (rows * rows).sum(axis=1)
    return code, far


def _positions(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch, their parts)."""
    position = batch["pos"].to_numpy(zero_copy_only=False)
    lists = batch["part"]
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    for p in np.unique(position):
        rows = np.flatnonzero(position == p)
        width = int(starts[rows[0] + 1] - starts[rows[0]])
        yield int(p), rows, flat[starts[rows][:, None] + np.arange(width)]


def _sums(books: list[np.ndarray]):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weight and weighted sums of each entry's parts."""
        weight = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            n = batch["n"].to_numpy()
            for p, rows, x in _positions(batch):
                code, _ = nearest(x, books[p])
                order = np.argsort(code, kind="stable")
                entry, first = np.unique(code[order], return_index=True)
                weight[p][entry] += np.add.reduceat(n[rows][order], first)
                total[p][entry] += np.add.reduceat((x * n[rows][:, None])[order], first)
        for p in range(len(books)):
            used = np.flatnonzero(weight[p])
            width = books[p].shape[1]
            k, j = np.repeat(used, width), np.tile(np.arange(width), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), p, np.int32)), pa.array(k.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[p][k, j]), pa.array(weight[p][k])], names=["pos", "entry", "axis", "total", "n"])

    return sums


def _assign(books: list[np.ndarray]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, x in _positions(batch):
                code[rows], far[rows] = nearest(x, books[p])
            yield pa.RecordBatch.from_arrays([batch["pos"], batch["part"], batch["n"], pa.array(code), pa.array(far)], names=["pos", "part", "n", "code", "far"])

    return assign


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, decimal and joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def train(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weighted Lloyd rounds over distinct parts (pos, part, n)."""
    for _ in range(rounds):
        new = [b.copy() for b in books]
        found = distinct.mapInArrow(_sums(books), "pos int, entry int, axis int, total bigint, n bigint")
        for r in found.groupBy("pos", "entry", "axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # one row for each component of the codebooks
            new[r["pos"]][r["entry"], r["axis"]] = r["total"] // r["n"]
        books = new
    return books


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """One row for each kept vector: vec_id, code, error, label_error and codebooks_sha256."""
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    width = dimension(named, "v")
    whole = lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int")
    kept = C.stash(named.where(F.size("v") == width).select("vec_id", "label", F.transform("v", whole).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    cuts = part_columns(width, parts)
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    cut = F.posexplode(F.array(*[F.slice("v", a + 1, b - a) for a, b in cuts])).alias("pos", "part")
    distinct = C.stash(kept.select(cut).groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    books = [np.array([v[a:b] for v in first], np.int64).reshape(len(first), b - a) for a, b in cuts]
    if first:
        books = train(distinct, books, rounds)
    coded = C.stash(distinct.mapInArrow(_assign(books), "pos int, part array<int>, n bigint, code int, far bigint"), "codes")
    often = F.col("n") > max(1, kept.count() // heavy)
    common, rest = (coded.where(x).select("pos", "part", "code", "far") for x in (often, ~often))
    cells = kept.select("row", "vec_id", "label", cut)
    known = cells.join(F.broadcast(common), ["pos", "part"]).unionByName(cells.join(F.broadcast(common.select("pos", "part")), ["pos", "part"], "left_anti").join(rest, ["pos", "part"]))
    code = F.sum(F.col("code").cast("bigint") * F.element_at(F.array(*[F.lit(256 ** (parts - 1 - p)) for p in range(parts)]), F.col("pos") + 1))
    coded_rows = C.stash(known.groupBy("row", "vec_id", "label").agg(code.alias("code"), F.sum("far").alias("error")), "coded")
    by_label = coded_rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = coded_rows.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    C.drop(kept, distinct, coded)
    return out.select("vec_id", F.lower(F.lpad(F.hex("code"), 2 * parts, "0")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
