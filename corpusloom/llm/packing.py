"""Best-fit packing of documents into fixed-size sequences under conflict constraints.

Documents are dealt to shards of about SHARD rows by a salted hash, so that a hot source or cluster spreads over all
shards; each shard is packed by itself, so a task's work and memory are bounded at any corpus size. Within a shard, pieces
go longest first (then by id and place). Open bins are kept by residual; a bitmap over residuals gives the tightest
bin that still fits, and the successor search goes on from residual to residual until a compatible bin is found. Each
bin carries a bitmap of its sources and one of its duplicate clusters; a bin is compatible if it has neither the
piece's source nor its cluster. Bins of one residual with one source bitmap are held together, so a whole group that
conflicts is passed over at once. If no open bin will do, a new one is opened; nothing is dropped.

A document longer than a bin is cut into pieces of full bins and a rest; pieces of one document share its
cluster, so they never meet. Clusters are texts equal after lower-casing A-Z and dropping white space.

Defined cases: null texts count as empty; a text without words has one piece of length 0, which goes into a bin like any
other; null sources conflict with nothing; rows repeated under one id conflict as copies do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY, SHARD = 2048, 2048


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and the cluster of each text; the text goes no further."""
    for batch in batches:
        raw, off = C.buffers(batch["__text"])
        data = C._LOWER[raw].tobytes() if len(raw) else b""
        n, cluster = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            words = data[a:b].split()
            n.append(len(words))
            cluster.append(int.from_bytes(hashlib.blake2b(b"".join(words), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([batch["__id"], batch["__source"], pa.array(cluster, pa.int64()), pa.array(n, pa.int64())], names=["__id", "__source", "__cluster", "__n"])


class Shelf:
    """Open bins of one shard, by residual and source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: list[dict[int, dict[int, int]]] = [{} for _ in range(capacity + 1)]
        self.used = 0  # bit r: some bin has residual r
        self.clock = 0  # bins of a group stand in the order in which they came to it
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.free: list[int] = []

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """The tightest compatible bin; of several, the one that has had its residual for longest."""
        above = self.used >> size << size
        while above:
            r = (above & -above).bit_length() - 1
            best, since = None, self.clock + 1
            for mask, bins in self.levels[r].items():
                if mask & source:
                    continue
                for k, came in bins.items():
                    if came > since:
                        break
                    if not self.clusters[k] & cluster:
                        best, since = k, came
                        break
            if best is not None:
                return best
            above &= above - 1
        return None

    def _leave(self, k: int) -> None:
        level = self.levels[self.free[k]]
        group = level[self.sources[k]]
        del group[k]
        if not group:
            del level[self.sources[k]]
            if not level:
                self.used &= ~(1 << self.free[k])

    def _enter(self, k: int) -> None:
        self.clock += 1
        self.levels[self.free[k]].setdefault(self.sources[k], {})[k] = self.clock
        self.used |= 1 << self.free[k]

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece."""
        k = self.find(size, source, cluster)
        if k is None:
            k = len(self.free)
            self.free.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            self._leave(k)
        at = self.capacity - self.free[k]
        self.free[k] -= size
        self.sources[k] |= source
        self.clusters[k] |= cluster
        self._enter(k)
        return k, at


def pieces(sizes: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(row, piece, length) in packing order: longest first, then by row and piece."""
    out = []
    for row, n in enumerate(sizes):
        whole, rest = divmod(n, capacity)
        out += [(row, k, capacity) for k in range(whole)]
        if rest or not whole:
            out.append((row, whole, rest))
    out.sort(key=lambda x: (-x[2], x[0], x[1]))
    return out


def _pack(capacity: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("shard", pa.int64()), ("bin", pa.int64()), ("bin_offset", pa.int32()), ("n_words", pa.int32())])

    def pack(shard: pa.Table) -> pa.Table:
        rows = shard.sort_by([("__id", "ascending"), ("__cluster", "ascending"), ("__source", "ascending"), ("__n", "ascending")])
        number: dict = {}
        bit = lambda x: 1 << number.setdefault(x, len(number))
        clusters = [bit(x) for x in rows["__cluster"].to_pylist()]
        number = {}
        sources = [0 if x is None else bit(x) for x in rows["__source"].to_pylist()]
        shelf = Shelf(capacity)
        out = []
        for row, k, n in pieces(rows["__n"].to_pylist(), capacity):
            out.append((row, k, *shelf.put(n, sources[row], clusters[row]), n))
        row, k, b, at, n = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
        s = shard["__shard"][0].as_py()
        return pa.table([rows["__id"].take(pa.array(row)), pa.array(k, pa.int32()), pa.array([s] * len(out), pa.int64()), pa.array(b), pa.array(at, pa.int32()), pa.array(n, pa.int32())], schema=schema)

    return pack


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, shard, bin (within the shard), bin_offset and n_words."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), source.alias("__source"))
    id_type = slim.schema["__id"].dataType
    shards = max(1, -(-docs.select(id_col).count() // shard))
    measured = slim.mapInArrow(_measure, f"__id {id_type.simpleString()}, __source string, __cluster bigint, __n bigint")
    dealt = measured.withColumn("__shard", F.pmod(F.xxhash64("__id", "__cluster"), F.lit(shards)))
    return dealt.groupBy("__shard").applyInArrow(_pack(capacity, to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, piece int, shard bigint, bin bigint, bin_offset int, n_words int")
