"""Exact dedup of texts that are equal without their white space.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints: a fingerprint falls into a quotient
(its slot) and a remainder; a slot's remainders lie in ascending order, with counters. Since quotient and remainder give
the fingerprint back, filters merge without loss: slot ranges of all partitions are shuffled and merged by sorted
remainder, counters added. Only fingerprints counted more than once are routed on: a fixed-size mask of them
(MASK_BITS, whatever the corpus; a fuller mask only routes more texts) lets the second scan keep candidate texts alone,
which are then compared byte by byte as grouping keys. Partial aggregation leaves one row for each text and task before
that shuffle, so a text that a third of all rows hold costs no more than another.

Defined cases: null counts as empty; empty texts form a group of their own; the row with the most code points in
its original text stays, then the smallest id (a null id only if there is no other); rows that repeat both id and
text share one verdict and are counted one by one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Size of the mask of routed fingerprints that every task gets: 2 MB.
MASK_BITS = 24
#: Bits of a fingerprint that name its slot in a partition's filter.
QUOTIENT_BITS = 16


class CountingQuotientFilter:
    """A counting quotient filter held as arrays: `run` (number of remainders in each used slot), `slot` (the used
    slots, ascending), `rem` (the remainders, ascending within a slot) and `count` (their counters)."""

    def __init__(self, slot: np.ndarray, run: np.ndarray, rem: np.ndarray, count: np.ndarray):
        self.slot, self.run, self.rem, self.count = slot, run, rem, count

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        c = np.ones(len(f), np.int64) if counts is None else counts[order]
        head = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)
        f, c = f[head], np.add.reduceat(c, head) if len(head) else c
        slot, run = np.unique(f >> np.uint64(64 - QUOTIENT_BITS), return_counts=True)
        return cls(slot, run, f & np.uint64((1 << (64 - QUOTIENT_BITS)) - 1), c)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.slot, self.run) << np.uint64(64 - QUOTIENT_BITS)) | self.rem

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        return cls.build(np.concatenate([x.fingerprints() for x in filters]), np.concatenate([x.count for x in filters]))

    def ranges(self, parts: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut into `parts` equal ranges of slots."""
        of = (self.slot * np.uint64(parts)) >> np.uint64(QUOTIENT_BITS)
        ends = np.concatenate(([0], np.cumsum(self.run)))
        for p in np.unique(of):
            a, b = np.searchsorted(of, p), np.searchsorted(of, p, side="right")
            yield int(p), CountingQuotientFilter(self.slot[a:b], self.run[a:b], self.rem[ends[a] : ends[b]], self.count[ends[a] : ends[b]])

    def pack(self) -> dict:
        return {"slots": C.pack_sorted(self.slot.astype(np.uint64)), "runs": C.pack_counts(self.run), "rems": self.rem.astype("<u8").tobytes(), "counts": self.count.astype("<i8").tobytes()}

    @classmethod
    def unpack(cls, x: dict) -> CountingQuotientFilter:
        return cls(C.unpack_sorted(x["slots"]), C.unpack_counts(x["runs"]).astype(np.int64), np.frombuffer(x["rems"], "<u8"), np.frombuffer(x["counts"], "<i8"))


def _normal(texts: pa.Array) -> Iterator[bytes]:
    raw, off = C.buffers(texts)
    data = raw.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield data[a:b].translate(None, C.SPACES)


def _fingerprint(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in digests), "<u8")


def _build(parts: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(CountingQuotientFilter.build(_fingerprint([hashlib.sha256(x).digest() for x in _normal(batch["__text"])])))
            if len(held) >= 16:
                held = [CountingQuotientFilter.merge(held)]
        if held:
            rows = [{"part": p, **f.pack()} for p, f in CountingQuotientFilter.merge(held).ranges(parts)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), *[(k, pa.binary()) for k in ("slots", "runs", "rems", "counts")]]))

    return build


def _merge(bits: int):
    def merge(rows: pa.Table) -> pa.Table:
        """The mask's stretch for this range of slots: its first byte's place, and the bytes up to the last one set."""
        f = CountingQuotientFilter.merge([CountingQuotientFilter.unpack(x) for x in rows.to_pylist()])
        routed = f.fingerprints()[f.count > 1]
        at = np.unique(routed >> np.uint64(64 - bits)).astype(np.int64)
        if not len(at):
            return pa.table({"at": pa.array([], pa.int64()), "mask": pa.array([], pa.binary())})
        first = int(at[0]) // 8
        own = np.zeros((int(at[-1]) // 8 - first + 1) * 8, np.uint8)
        own[at - first * 8] = 1
        return pa.table({"at": pa.array([first], pa.int64()), "mask": pa.array([np.packbits(own).tobytes()], pa.binary())})

    return merge


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(x).digest() for x in _normal(batch["__text"])]
        yield pa.RecordBatch.from_arrays([batch["__id"], batch["__cp"], pa.array(sha, pa.binary())], names=["__id", "__cp", "__sha"])


def _candidates(shared, bits: int):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            norm = list(_normal(batch["__text"]))
            sha = [hashlib.sha256(x).digest() for x in norm]
            at = (_fingerprint(sha) >> np.uint64(64 - bits)).astype(np.int64)
            use = np.flatnonzero((mask[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            if len(use):
                part = batch.take(pa.array(use))
                yield pa.RecordBatch.from_arrays([part["__id"], part["__cp"], pa.array([sha[i] for i in use], pa.binary()), pa.array([norm[i] for i in use], pa.binary())], names=["__id", "__cp", "__sha", "__norm"])

    return candidates


def routed_mask(texts: DataFrame, bits: int = MASK_BITS) -> bytes:
    """The mask of fingerprints counted more than once in the merged filters; 2**bits bits at any size."""
    n = C.partitions(texts.sparkSession)
    filters = texts.select("__text").mapInArrow(_build(n), "part int, slots binary, runs binary, rems binary, counts binary")
    mask = np.zeros(1 << (bits - 3), np.uint8)
    for row in filters.groupBy("part").applyInArrow(_merge(bits), "at bigint, mask binary").collect():  # 2**bits bits in all
        own = np.frombuffer(row["mask"], np.uint8)
        mask[row["at"] : row["at"] + len(own)] |= own
    return mask.tobytes()


def _groups(sized: DataFrame, mask, id_type: str) -> DataFrame:
    """Groups of two or more equal texts: sha, keep_id, keep_cp, group_size. Candidates are compared byte by byte."""
    kept = F.min(F.struct((-F.col("__cp")).alias("neg"), F.col("__id").isNull().alias("none"), F.col("__id").alias("id"))).alias("best")
    return (
        sized.mapInArrow(_candidates(mask, MASK_BITS), f"__id {id_type}, __cp int, __sha binary, __norm binary")
        .groupBy("__norm", "__sha").agg(kept, F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        .select(F.col("__sha").alias("sha"), F.col("best.id").alias("keep_id"), (-F.col("best.neg")).alias("keep_cp"), "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    slim = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    mask = docs.sparkSession.sparkContext.broadcast(routed_mask(slim))
    sized = slim.withColumn("__cp", F.char_length("__text"))
    id_type = slim.schema["__id"].dataType.simpleString()
    each = sized.mapInArrow(_describe, f"__id {id_type}, __cp int, __sha binary")
    joined = each.join(_groups(sized, mask, id_type), F.col("__sha") == F.col("sha"), "left")
    alone = F.col("sha").isNull()
    return joined.select(
        F.col("__id").alias("doc_id"),
        F.when(alone, F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__cp") == F.col("keep_cp")))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def removed_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids that exact dedup drops. Only candidates take part: a text whose fingerprint is counted once stays."""
    slim = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    mask = docs.sparkSession.sparkContext.broadcast(routed_mask(slim))
    sized = slim.withColumn("__cp", F.char_length("__text"))
    id_type = slim.schema["__id"].dataType.simpleString()
    some = sized.mapInArrow(_candidates(mask, MASK_BITS), f"__id {id_type}, __cp int, __sha binary, __norm binary").select("__id", "__sha")
    joined = some.join(_groups(sized, mask, id_type), F.col("__sha") == F.col("sha"))
    return joined.where(~F.col("__id").eqNullSafe(F.col("keep_id"))).select(F.col("__id").alias("doc_id"))
