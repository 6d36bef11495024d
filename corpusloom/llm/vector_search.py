"""Nearest neighbours by cosine: an inverted file whose lists are scanned by growing numbers of dimensions.

0. Surplus: of many equal vectors those with the k + 1 smallest ids are stored; the others can be in no result, but are queries like any other.
1. Lists: k-means on a bounded sample of unit vectors gives centroids, one for about LIST vectors, LISTS at most. Every row goes to the list of
   its nearest centroid.
2. Probes: the exact neighbours of TRIAL queries, taken among all rows in one pass, show how many lists a query must probe for them;
   the smallest number that finds RECALL of them is used for all.
3. Search: lists that follow each other along a chain of near centroids share a cell of about CELL vectors; a larger list is dealt over several cells. A query goes once
   to each cell that has a list it probes, and many queries of one cell are dealt over several groups. In a group, vectors are turned by a random rotation and stored in
   column blocks; a query's lists are scanned nearest first. After each block a hypothesis test drops the candidates whose distance, judged by the
   dimensions seen, is beyond the k-th best so far at confidence EPSILON; what is left after the last block is scored exactly on the original vectors in double precision.

The sample and the trial queries are bounded (SAMPLE_PER_LIST * LISTS rows and SAMPLE components, TRIAL rows) and drawn by a hash of the row, and so is the model, whatever the input.

Defined cases: vectors that are null, zero, without components or with null or non-finite ones take no part, nor do those of another length than most have; null ids are no queries, and come
last among equal scores; rows that repeat an id are rows of their own, also as queries; a query has every row but itself as candidate, so equal vectors find each
other; fewer candidates than k are all returned, as all lists are probed then; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common as C
from .lexical_search import best
from .vectors import dimension, usable

K, LIST, LISTS, SAMPLE_PER_LIST, TRIAL, RECALL = 5, 512, 4096, 32, 256, 0.98
CELL, QUERIES, COLUMNS, EPSILON = 16384, 2048, 16, 2.1
#: Components of all sample vectors together.
SAMPLE = 1 << 23
#: Float noise of a squared distance of unit vectors.
NOISE = 1e-5


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, largest component in [0.5, 1): angles stay, squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed component by component, so equal pairs have equal cosines wherever they stand."""
    a, b = scaled(a), scaled(b)
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        x += a[:, j] * a[:, j]
        y += b[:, j] * b[:, j]
    return dot / (np.sqrt(x) * np.sqrt(y))


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the result runs along a chain of near centroids."""
    rng = np.random.default_rng(k)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        total = np.add.reduceat(sample[order], first)
        length = np.sqrt((total * total).sum(axis=1))
        c[used[length > 1e-9]] = (total / np.maximum(length, 1e-9)[:, None])[length > 1e-9]
    chain, left, at = [], np.ones(k, bool), 0
    for _ in range(k):
        chain.append(at)
        left[at] = False
        at = int(np.where(left, c @ c[at], -np.inf).argmax())
    return c[chain]


def _assign(c: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch["v"], c.shape[1]))
            near = [(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(near or [np.zeros(0, int)]).astype(np.int32))], names=[*batch.schema.names, "list"])

    return assign


def _trial(queries: np.ndarray, rows: np.ndarray, k: int):
    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of a batch for each trial query, with their lists."""
        for batch in batches:
            x, row, near = unit(matrix(batch["v"], queries.shape[1])), batch["row"].to_numpy(), batch["list"].to_numpy()
            score = queries @ x.T
            score[rows[:, None] == row[None, :]] = -2
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(queries)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(near[top.ravel()]), pa.array(score[q, top.ravel()])], names=["q", "list", "score"])

    return trial


def probes(listed: DataFrame, stored: DataFrame, c: np.ndarray, is_query, k: int, recall: float) -> int:
    """How many lists a query must probe, by trial queries against all rows."""
    drawn = listed.where(is_query).orderBy(F.xxhash64("row"), "row").limit(TRIAL).select("row", "v").collect()
    if not drawn:
        return 1
    rows, q = np.array([r["row"] for r in drawn]), unit(np.array([r["v"] for r in drawn], np.float64))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    found = stored.select("row", "v", "list").mapInArrow(_trial(q, rows, k), "q int, list int, score double").withColumn("n", F.row_number().over(best))
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)
    needed = sorted(int(rank[r["q"], r["list"]]) + 1 for r in found.where((F.col("n") <= k) & (F.col("score") > -2)).collect())  # k rows for each trial query
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def _route(c: np.ndarray, probe: int, cells: list[tuple[int, int]]):
    """cells[list]: (first cell, number of cells) of a list."""
    first, many = np.array(cells, np.int64).T

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each cell that has a list the query probes, with these lists, nearest first."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch["v"], c.shape[1]))
            at, cell, lists = [], [], []
            for i in range(len(x)):
                found: dict[int, list[int]] = {}
                for near in np.argsort(-(c @ x[i]), kind="stable")[:probe].tolist():
                    for part in range(first[near], first[near] + many[near]):
                        found.setdefault(part, []).append(near)
                at += [i] * len(found)
                cell += found.keys()
                lists += found.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["row"].take(take), batch["vec_id"].take(take), batch["v"].take(take), pa.array(cell, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["row", "vec_id", "v", "cell", "lists"])

    return route


def scan(q: np.ndarray, blocks: list[np.ndarray], parts: list[tuple[int, int]], own: int, k: int, epsilon: float = EPSILON, step: int = 512) -> tuple[np.ndarray, int]:
    """(rows that may be among the k nearest to q, components read). blocks: columns of the rotated vectors, one array for a few dimensions; parts: ranges of
    rows in the order in which to scan them; own: the query's own row, or -1."""
    width, edge = len(q), np.cumsum([b.shape[1] for b in blocks])
    rows, far, limit, read = np.zeros(0, np.int64), np.zeros(0), np.inf, 0
    for a, b in parts:
        for low in range(a, b, step):
            live = np.arange(low, min(b, low + step))
            live = live[live != own]
            d = np.zeros(len(live))
            for block, seen in zip(blocks, edge.tolist(), strict=True):
                gap = block[live] - q[seen - block.shape[1] : seen]
                d += np.einsum("ij,ij->i", gap, gap)
                read += gap.size
                bar = limit * seen / width * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < width else limit
                stay = d <= bar + NOISE
                live, d = live[stay], d[stay]
                if not len(live):
                    break
            if len(live):
                rows, far = np.concatenate((rows, live)), np.concatenate((far, d))
                if len(far) >= k:
                    limit = min(limit, float(np.partition(far, k - 1)[k - 1]))
                    stay = far <= limit + NOISE
                    rows, far = rows[stay], far[stay]
    return rows, read


def _scan(width: int, k: int, columns: int, id_type: pa.DataType):
    turn = rotation(width).astype(np.float32)
    schema = pa.schema([("query_row", pa.int64()), ("query_id", id_type), ("vec_id", id_type), ("score", pa.float64())])

    def search(stored: pa.Table, queries: pa.Table) -> pa.Table:
        if not stored.num_rows or not queries.num_rows:
            return schema.empty_table()
        stored, queries = stored.sort_by([("list", "ascending"), ("row", "ascending")]), queries.sort_by("row")
        x, q = matrix(stored["v"], width), matrix(queries["v"], width)
        lists, row = stored["list"].to_numpy(), stored["row"].to_numpy()
        turned, sought = unit(x).astype(np.float32) @ turn, unit(q).astype(np.float32) @ turn
        blocks = [np.ascontiguousarray(turned[:, j : j + columns]) for j in range(0, width, columns)]
        place = {r: i for i, r in enumerate(row.tolist())}
        number, found = [], []
        for i, (r, near) in enumerate(zip(queries["row"].to_pylist(), queries["lists"].to_pylist(), strict=True)):
            a, b = np.searchsorted(lists, near), np.searchsorted(lists, near, side="right")
            rows, _ = scan(sought[i], blocks, list(zip(a.tolist(), b.tolist(), strict=True)), place.get(r, -1), k)
            number.append(np.full(len(rows), i))
            found.append(rows)
        number, found = np.concatenate(number), np.concatenate(found)
        score = np.concatenate([cosines(q[number[i : i + 65536]], x[found[i : i + 65536]]) for i in range(0, len(found), 65536)] or [np.zeros(0)])
        ids = stored["vec_id"].combine_chunks().take(pa.array(found))
        keep = best(number, score, ids, k)
        n = pa.array(number[keep])
        return pa.table([queries["row"].combine_chunks().take(n), queries["vec_id"].combine_chunks().take(n), ids.take(pa.array(keep)), pa.array(score[keep])], schema=schema)

    return search


def layout(sizes: list[int], cell: int) -> tuple[list[tuple[int, int]], int]:
    """((first cell, number of cells) of each list, number of cells): neighbouring lists share a cell, a list beyond its size has several."""
    out, at, used = [], 0, 0
    for n in sizes:
        many = max(1, -(-n // cell))
        if used and (many > 1 or used + n > cell):
            at, used = at + 1, 0
        out.append((at, many))
        if many > 1:
            at += many
        else:
            used += n
    return out, at + (used > 0)


def without_surplus(listed: DataFrame, k: int) -> DataFrame:
    """Of equal vectors only the k + 1 with the smallest ids can be among a query's k nearest. Vectors with few copies are left as they are;
    what has many goes through a window, whose limit applies before its shuffle."""
    hashed = listed.withColumn("hash", F.xxhash64("v"))
    many = C.stash(hashed.groupBy("hash").count().where(F.col("count") > 16 * (k + 1)).select("hash"), "copies")
    first = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "row")
    kept = hashed.join(many, "hash", "left_semi").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")
    return C.stash(hashed.join(many, "hash", "left_anti").unionByName(kept).drop("hash"), "stored")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL, list_size: int = LIST, cell: int = CELL, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score (cosine): the k nearest found for each row that the condition `is_query` (on vec_id) names."""
    from pyspark.sql.pandas.types import to_arrow_type

    vector = F.col(vector_col)
    if vectors.schema[vector_col].dataType.elementType != FloatType():
        vector = vector.cast("array<double>")
    named = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("v"))
    id_type = named.schema["vec_id"].dataType
    name, array = id_type.simpleString(), named.schema["v"].dataType.simpleString()
    sound = named.where(usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    width = dimension(sound, "v")
    kept = C.stash(sound.where(F.size("v") == width).withColumn("row", F.monotonically_increasing_id()), "vectors")
    count = kept.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], f"query_id {name}, rank int, vec_id {name}, score double")
    lists = min(LISTS, max(1, count // list_size))
    drawn = kept.orderBy(F.xxhash64("row"), "row").limit(min(lists * SAMPLE_PER_LIST, max(1, SAMPLE // width))).select("v").toArrow()
    c = centroids(unit(matrix(drawn["v"], width)), min(lists, drawn.num_rows))
    listed = C.stash(kept.mapInArrow(_assign(c), f"vec_id {name}, v {array}, row bigint, list int"), "listed")
    C.drop(kept)
    asked = F.coalesce(is_query, F.lit(False))
    stored = without_surplus(listed, k)
    probe = probes(listed, stored, c, asked, k, recall)
    by_list = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}  # one row for each centroid
    if sum(sorted(by_list.get(i, 0) for i in range(len(c)))[:probe]) <= k:
        probe = len(c)
    cells, _ = layout([by_list.get(i, 0) for i in range(len(c))], max(1024, cell * 64 // max(64, width)))
    many = F.array(*[F.lit(n) for _, n in cells])
    first = F.array(*[F.lit(a) for a, _ in cells])
    stored = stored.withColumn("cell", F.get(first, F.col("list")) + F.pmod(F.xxhash64("row"), F.get(many, F.col("list")).cast("bigint")))
    routed = C.stash(listed.where(asked).select("row", "vec_id", "v").mapInArrow(_route(c, probe, cells), f"row bigint, vec_id {name}, v {array}, cell bigint, lists array<int>"), "routed")
    # Queries of a cell are dealt over as many groups as their number asks for; the cell's vectors go to each of them.
    split = routed.groupBy("cell").agg(F.ceil(F.count("*") / queries).cast("bigint").alias("groups"))
    left = stored.join(split, "cell").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("part"))
    right = routed.join(split, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("groups")))
    left, right = left.select("cell", "part", "row", "vec_id", "v", "list"), right.select("cell", "part", "row", "vec_id", "v", "lists")
    hits = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(_scan(width, k, COLUMNS, to_arrow_type(id_type)), f"query_row bigint, query_id {name}, vec_id {name}, score double")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
