"""Ranked lexical search over a clustered index of documents that recursive graph bisection has reordered.

1. Describe: one pass over the texts gives each document's length and the counts of those terms that the queries of a pass
   have. Terms are found by hash and then compared byte by byte. Counts of documents and lengths cover all documents.
2. Index: documents are dealt to shards of about SHARD rows. In a shard, recursive bisection orders documents: a range is cut
   in two halves, and pairs of documents change sides as long as that lowers the summed log-gap cost of the terms' degrees in both halves;
   then each half is cut, down to ranges of at most CLUSTER documents. A range is a cluster: its row has its postings
   with their exact integer impacts, and for each term the largest impact.
3. Search: what a query's terms can reach at most in a cluster, summed, is the cluster's bound. Each query first opens the SEEDS clusters with its
   highest bounds; its k-th score there is a floor. Then every task goes through its clusters, highest bound first, raises its floors as it
   scores, and passes over a cluster for every query whose floor is above the bound, so the k best are exact. Clusters that tie with the floor are
   opened; equal scores go by doc_id, whatever place bisection gave the document.

Queries come to the driver in order of their ids, in passes of at most TERMS distinct terms and blocks of at most CELLS terms times
items (an item that has more is a pass or block of its own); so what is sent to tasks is bounded, and the corpus is read once a pass.

Defined cases: null and term-less texts and items match nothing (such documents are in no count); texts of any length are read whole; rows that repeat
a doc_id are documents of their own and take ranks of their own; rows that repeat an item's id are one item with the terms of both, and
so are items without an id; null doc_ids come last among equal scores; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K, SHARD, CLUSTER, SEEDS = 50, 2048, 64, 4
#: Terms of a pass over the corpus, and terms times items of a block of queries.
TERMS, CELLS = 1 << 20, 1 << 22
ROUNDS = 10

_TERM = np.full(256, 32, np.uint8)
_TERM[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = [c for c in C.LOWER if c >= 128 or chr(c).isalnum()]


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> C.Words:
    """The terms of a batch of texts: other bytes become spaces, A-Z lower case."""
    return C.Words(_TERM[raw], offsets)


class Vocabulary:
    """Numbers of known terms. Equal numbers if and only if equal bytes."""

    def __init__(self, terms: list[bytes]):
        self.words = C.Words(*C.buffers(pa.array(terms, pa.binary())))
        hashes = self.words.hashes()
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        clash = (self.hashes[1:] == self.hashes[:-1]).any()
        self.number = {t: i for i, t in enumerate(terms)} if clash else None

    def find(self, words: C.Words) -> tuple[np.ndarray, np.ndarray]:
        """(which words are known, their numbers)."""
        if not len(self.hashes) or not len(words.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.number is not None:
            data = words.raw.tobytes()
            got = np.array([self.number.get(data[a:b], -1) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)], np.int64)
            return np.flatnonzero(got >= 0), got[got >= 0]
        hashes = words.hashes()
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == hashes)
        known = self.order[place[at]]
        same = words.ends[at] - words.starts[at] == self.words.ends[known] - self.words.starts[known]
        at, known = at[same], known[same]
        view, other, length = words.chunks(), self.words.chunks(), words.ends[at] - words.starts[at]
        rest, same, k = np.arange(len(at)), np.ones(len(at), bool), 0
        while len(rest):
            x = (view[words.starts[at[rest]] + k] ^ other[self.words.starts[known[rest]] + k]) & C._ENDS[np.minimum(length[rest] - k, 8)]
            same[rest[x != 0]] = False
            k += 8
            rest = rest[(x == 0) & (length[rest] > k)]
        return at[same], known[same]


def _describe(terms: list[bytes]):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Length, known terms and their counts of each text that has a term."""
        known = Vocabulary(terms)
        for batch in batches:
            raw, offsets = C.buffers(batch["__text"])
            for i, j in C.slices(offsets):
                words = terms_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(words.at)
                at, term = known.find(words)
                doc = np.searchsorted(words.at, at, side="right") - 1
                key, tf = np.unique(doc * len(terms) + term, return_counts=True)
                has = np.flatnonzero(n)
                ends = np.searchsorted(key, np.append(has, j - i) * len(terms)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(terms)), tf)]
                yield pa.RecordBatch.from_arrays([batch["__id"].slice(i, j - i).take(pa.array(has)), pa.array(n[has]), *lists], names=["__id", "n", "terms", "tfs"])

    return describe


def bisect(doc: np.ndarray, term: np.ndarray, n: int, leaf: int = CLUSTER, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(order of n documents, bounds of its leaves): recursive bisection of the graph with edges (doc, term). All ranges of a
    level are worked on at once."""
    order, bounds = np.arange(n), np.array([0, n])
    width = int(term.max()) + 1 if len(term) else 1
    while (np.diff(bounds) > leaf).any():
        low, size = bounds[:-1], np.diff(bounds)
        middle = np.where(size > leaf, low + (size + 1) // 2, bounds[1:])
        cuts = np.append(np.stack((low, middle), axis=1).ravel(), n)  # half 2 * k + side of range k
        sizes = np.diff(cuts)
        half = np.empty(n, np.int64)
        half[order] = np.repeat(np.arange(len(sizes)), sizes)
        keys, edge = np.unique((half[doc] >> 1) * width + term, return_inverse=True)
        room = sizes.reshape(-1, 2)[keys // width].astype(float)
        for _ in range(rounds):
            side = half & 1
            degree = np.bincount(edge * 2 + side[doc], minlength=2 * len(keys)).reshape(-1, 2)
            cost = lambda d, s: d * np.log2(np.maximum(room[:, s], 1) / (d + 1.0))
            now = cost(degree[:, 0], 0) + cost(degree[:, 1], 1)
            moved = np.stack([now - cost(np.maximum(degree[:, s] - 1, 0), s) - cost(degree[:, 1 - s] + 1, 1 - s) for s in (0, 1)], axis=1)
            gain = np.bincount(doc, weights=moved[edge, side[doc]], minlength=n)
            ranked = np.lexsort((np.arange(n), -gain, half))
            left = np.flatnonzero(half[ranked] & 1 == 0)
            rank = left - cuts[half[ranked[left]]]
            left, rank = left[(fits := rank < sizes[half[ranked[left]] + 1])], rank[fits]
            one, two = ranked[left], ranked[cuts[half[ranked[left]] + 1] + rank]
            swap = gain[one] + gain[two] > 1e-9
            if not swap.any():
                break
            half[one[swap]] += 1
            half[two[swap]] -= 1
        order = order[np.argsort(half[order], kind="stable")]
        bounds = np.unique(cuts)
    return order, bounds


def _shard(id_type: pa.DataType, documents: int, length: int, leaf: int):
    fields = [("cid", pa.int64()), ("ids", pa.list_(id_type)), ("heads", pa.binary()), ("tops", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("impacts", pa.binary())]

    def build(rows: pa.Table) -> pa.Table:
        """The clusters of one shard."""
        rows = rows.sort_by("slot").combine_chunks()
        shard, ids, n = rows["shard"][0].as_py(), rows["__id"].combine_chunks(), rows["n"].to_pylist()
        at = np.concatenate(([0], np.cumsum(rows["terms"].combine_chunks().value_lengths().to_numpy())))
        term, tf = (rows[x].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(n)), np.diff(at))
        m = np.array([50 + 50 * x * documents // length for x in n], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order, bounds = bisect(doc, term, len(n), leaf)
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        out = {name: [] for name, _ in fields}
        cluster = np.searchsorted(bounds, place, side="right") - 1
        edges = np.lexsort((place[doc], term, cluster[doc]))
        doc, term, impact = doc[edges], term[edges], impact[edges]
        cut = np.searchsorted(cluster[doc], np.arange(len(bounds)))
        for k in range(len(bounds) - 1):
            a, b = cut[k], cut[k + 1]
            heads, first, local = np.unique(term[a:b], return_index=True, return_inverse=True)
            tops = np.maximum.reduceat(impact[a:b], first) if b > a else impact[:0]
            out["cid"].append((shard << 24) + k)
            out["ids"].append(ids.take(pa.array(order[bounds[k] : bounds[k + 1]])).to_pylist())
            for name, x in (("heads", heads), ("tops", tops), ("docs", place[doc[a:b]] - bounds[k]), ("places", local), ("impacts", impact[a:b])):
                out[name].append(x.astype("<i4").tobytes())
        return pa.table(out, schema=pa.schema(fields))

    return build


class Block:
    """Queries of a block: weights of their terms, as tasks need them."""

    def __init__(self, items: list, terms: list[list[int]], weights: dict[int, int]):
        self.items = items
        own = sorted({t for x in terms for t in x})
        self.terms = np.array(own, np.int64)
        at = {t: i for i, t in enumerate(own)}
        heaviest = max((weights.get(t, 0) for t in own), default=0)
        exact = heaviest * 1_000_000 * max(map(len, terms), default=0) < 1 << 53  # then sums of doubles are whole numbers
        self.weight = np.zeros((len(own), len(items)), np.float64 if exact else np.int64)
        for i, x in enumerate(terms):
            for t in x:
                self.weight[at[t], i] = weights.get(t, 0)

    def rows(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which heads the block has, their rows of weights)."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, heads), len(self.terms) - 1)
        has = np.flatnonzero(self.terms[at] == heads)
        return has, at[has]

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """What each item can reach at most in each cluster of a batch."""
        out = np.zeros((batch.num_rows, len(self.items)), self.weight.dtype)
        for c, (heads, tops) in enumerate(zip(batch["heads"], batch["tops"], strict=True)):
            has, at = self.rows(np.frombuffer(heads.as_buffer(), "<i4"))
            out[c] = np.frombuffer(tops.as_buffer(), "<i4")[has].astype(self.weight.dtype) @ self.weight[at]
        return out

    def scores(self, batch: pa.RecordBatch, c: int, items: np.ndarray) -> np.ndarray:
        """Scores of the documents of cluster c (rows) for some items (columns)."""
        heads, docs, places, impacts = (np.frombuffer(batch[x][c].as_buffer(), "<i4") for x in ("heads", "docs", "places", "impacts"))
        has, at = self.rows(heads)
        impact = np.zeros((len(batch["ids"][c]), len(heads)), self.weight.dtype)
        impact[docs, places] = impacts
        return impact[:, has] @ self.weight[np.ix_(at, items)]


def best(item: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the k best of each item: highest score, then smallest id, null ids last."""
    import pyarrow.compute as pc

    number = np.empty(len(ids), np.int64)
    number[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    order = np.lexsort((number, -score, item))
    starts = np.flatnonzero(np.diff(item[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _seed(block: Block, seeds: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The clusters with an item's highest bounds."""
        for batch in batches:
            bound = block.bounds(batch)
            for i in range(len(block.items)):
                top = np.argsort(-bound[:, i], kind="stable")[:seeds]
                top = top[bound[top, i] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i, np.int32)), batch["cid"].take(pa.array(top)), pa.array(bound[top, i].astype(np.int64))], names=["item", "cid", "bound"])

    return seed


def _visit(block: Block, floor: np.ndarray, k: int, id_type: pa.DataType, item_type: pa.DataType, only: dict[int, list[int]] | None = None):
    """`only`: the items that open a cluster; without it, all whose bound reaches their floor."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = floor.copy()
        for batch in batches:
            bound = block.bounds(batch)
            cids = batch["cid"].to_pylist()
            item, score, ids, held = [], [], [], 0

            def settle():
                nonlocal item, score, ids, held
                if not item:
                    return
                x, s, d = np.concatenate(item), np.concatenate(score), pa.concat_arrays(ids)
                keep = best(x, s, d, k)
                x, s, d = x[keep], s[keep], d.take(pa.array(keep))
                full = np.flatnonzero(np.bincount(x, minlength=len(floors)) >= k)
                lowest = np.full(len(floors), np.iinfo(np.int64).max)
                np.minimum.at(lowest, x, s)
                floors[full] = np.maximum(floors[full], lowest[full])
                item, score, ids, held = [x], [s], [d], 0

            for c in np.argsort(-bound.max(axis=1, initial=0), kind="stable").tolist():
                open_for = np.array(only.get(cids[c], []), np.int64) if only is not None else np.flatnonzero((bound[c] > 0) & (bound[c] >= floors))
                if not len(open_for):
                    continue
                got = block.scores(batch, c, open_for).astype(np.int64)
                doc, x = np.nonzero((got > 0) & (got >= floors[open_for]))
                item.append(open_for[x])
                score.append(got[doc, x])
                ids.append(batch["ids"][c].values.take(pa.array(doc)))
                held += len(doc)
                if held > 16 * k * len(floors):
                    settle()
            settle()
            if item:
                names = pa.array(block.items, item_type).take(pa.array(item[0]))
                yield pa.RecordBatch.from_arrays([pa.array(item[0].astype(np.int32)), names, ids[0], pa.array(score[0])], names=["item", "item_id", "doc_id", "score"])

    return visit


def _passes(queries: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, terms) of the items of one pass after another, each with at most `most` distinct terms or one item."""
    items, terms, seen = [], [], set()
    for row in queries.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i").toLocalIterator():
        raw, offsets = C.buffers(pa.array([row.t], pa.string()))
        words = terms_of(raw, offsets)
        data = words.raw.tobytes()
        own = {data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)}
        if items and row.i == items[-1]:
            terms[-1] = sorted(own.union(terms[-1]))
        else:
            if items and len(seen | own) > most:
                yield items, terms
                items, terms, seen = [], [], set()
            items.append(row.i)
            terms.append(sorted(own))
        seen |= own
    if items:
        yield items, terms


def build_index(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, leaf: int = CLUSTER) -> tuple[DataFrame, dict[int, int]]:
    """(clusters, weight of each of `terms` by its place): the index of all documents over these terms."""
    from pyspark.sql.pandas.types import to_arrow_type

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    id_type = slim.schema["__id"].dataType
    name = id_type.simpleString()
    described = C.stash(slim.mapInArrow(_describe(terms), f"__id {name}, n bigint, terms array<int>, tfs array<int>").withColumn("slot", F.monotonically_increasing_id()), "described")
    count, length = described.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = described.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # at most one row for each of terms
    weights = {r["t"]: math.floor(1000 * math.log((2 * count + 2) / (2 * r["count"] + 1))) for r in found}
    dealt = described.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("slot"), F.lit(max(1, -(-count // shard)))))
    schema = f"cid bigint, ids array<{name}>, heads binary, tops binary, docs binary, places binary, impacts binary"
    index = C.stash(dealt.groupBy("shard").applyInArrow(_shard(to_arrow_type(id_type), count, max(1, length), leaf), schema), "clusters")
    C.drop(described)
    return index, weights


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, weights: dict[int, int], items: list, terms: list[list[int]], item_type, k: int = K, seeds: int = SEEDS) -> DataFrame:
    """item_id, rank, doc_id, score for one block of items, whose terms are given by their places in the index."""
    from pyspark.sql.pandas.types import to_arrow_type

    block = Block(items, terms, weights)
    id_type = index.schema["ids"].dataType.elementType
    hit = f"item int, item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score bigint"
    types = to_arrow_type(id_type), to_arrow_type(item_type)
    floor = np.zeros(len(items), np.int64)
    ahead = Window.partitionBy("item").orderBy(F.desc("bound"), "cid")
    bounds = index.select("cid", "heads", "tops").mapInArrow(_seed(block, seeds), "item int, cid bigint, bound bigint")
    only: dict[int, list[int]] = {}
    for r in bounds.withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= seeds).collect():  # `seeds` rows for each item
        only.setdefault(r["cid"], []).append(r["item"])
    if only:
        tried = _top(index.where(F.col("cid").isin(list(only))).mapInArrow(_visit(block, floor, k, *types, only), hit), k)
        for r in tried.where(F.col("rank") == k).collect():
            floor[r["item"]] = r["score"]
    return _top(index.mapInArrow(_visit(block, floor, k, *types), hit), k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, shard: int = SHARD, leaf: int = CLUSTER, most_terms: int = TERMS, most_cells: int = CELLS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k documents with the highest scores above 0 of each item."""
    spark, item_type, id_type = docs.sparkSession, queries.schema[item_col].dataType, docs.schema[id_col].dataType
    out = []
    for items, terms in _passes(queries, item_col, item_text, most_terms):
        vocabulary = sorted(set().union(*terms))
        number = {t: i for i, t in enumerate(vocabulary)}
        index, weights = build_index(docs, vocabulary, id_col, text_col, shard, leaf)
        first, seen = 0, set()
        for i, own in enumerate(terms):
            if i > first and len(seen.union(own)) * (i + 1 - first) > most_cells:
                out.append(search(index, weights, items[first:i], [[number[t] for t in x] for x in terms[first:i]], item_type, k))
                first, seen = i, set()
            seen.update(own)
        out.append(search(index, weights, items[first:], [[number[t] for t in x] for x in terms[first:]], item_type, k))
    if not out:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score bigint")
    return functools.reduce(DataFrame.unionAll, out)
