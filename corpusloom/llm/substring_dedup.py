"""Substring dedup: remove every word that lies in a window of words seen earlier.

Texts are dealt into blocks by ascending document id. A block's Rabin-Karp window hashes are sorted, made
distinct, and sent as packed runs to hash ranges; there the runs of all blocks are merged and counted, and each
block gets back one bit for each of its hashes: held by an earlier block or not. With its own first occurrences,
that tells a block which windows repeat; they merge into maximal intervals of words.

The hashes move once, about nine bytes each, the answers are bits, and texts move once (the block exchange is
reused). A hash that a third of all windows share is one key for each block, so no group is hot. Blocks and hash ranges are as many as
the session's shuffle partitions, or more where blocks would hold over 16 MB of files, and each is dealt to a partition of its own.

Defined cases: a null or blank text has no words and stays; texts of fewer words than a window stay; null ids come
last; rows with one id are ordered by text, so the second of two equal rows is removed whole; texts of any length are read whole, a
long one makes its block longer; a table without rows gives none; other columns, whatever their names, are carried only when named in
`carry`. A window is known by a polynomial modulo 2**61 - 1 and 32 bits of one with another base: among n windows the
expected number of false meetings is about n*n/2**94 (0.005 for 10**13 windows, 100 TB of text). The words themselves are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 20
SCHEMA = "doc_id {id}, n_words bigint, n_removed bigint, intervals array<struct<start:bigint,end:bigint>>, text string"


def by_id_ranges(docs: DataFrame, id_col: str, blocks: int) -> DataFrame:
    """Adds __t: which of `blocks` ascending ranges of ids a row is in. The driver sees only the blocks' bounds."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("double").alias("x"))
    probs = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(ids.approxQuantile("x", probs, 0.2 / blocks) if probs else []))
    edges = [float("-inf"), *[c for c in cuts if c != float("-inf")], float("inf")]
    if len(edges) < 3:
        edges = [float("-inf"), 0.0, float("inf")]
    put = Bucketizer(splits=edges, inputCol="__x", outputCol="__t", handleInvalid="keep")
    return put.transform(docs.withColumn("__x", F.col(id_col).cast("double"))).drop("__x").withColumn("__t", F.coalesce(F.col("__t").cast("int"), F.lit(len(edges))))


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by([("__id", "ascending"), ("__text", "ascending")]) if block.num_rows > 1 else block


def _block_windows(block: pa.Table, size: int, bits: int):
    """(words of each text, first word of each window, its hash and check) of a whole block."""
    raw, off = C.buffers(block["__text"])
    counts, starts, hashes, checks, base = [], [], [], [], 0
    for i, j in C.slices(off):
        w = C.Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        own = w.hashes()
        s, h = C.windows(own, w.at, size)
        counts.append(np.diff(w.at))
        starts.append(s + base)
        hashes.append(h & np.uint64(((1 << bits) - 1) << (64 - bits)))
        checks.append((C.windows(own, w.at, size, C.SECOND_BASE)[1] >> np.uint64(32)).astype(np.uint32))
        base += len(w.starts)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(counts, np.int64), cat(starts, np.int64), cat(hashes, np.uint64), cat(checks, np.uint32)


def _distinct(h: np.ndarray, check: np.ndarray):
    """(hashes, checks, first place, number of each) of the distinct pairs, ascending by hash."""
    keys, first, which = np.unique(h, return_index=True, return_inverse=True)
    if np.array_equal(check, check[first][which]):
        return keys, check[first], first, which
    both = np.empty(len(h), [("h", "<u8"), ("c", "<u4")])
    both["h"], both["c"] = h, check
    keys, first, which = np.unique(both, return_index=True, return_inverse=True)
    return keys["h"], keys["c"], first, which


def _send(size: int, labels: list[int], bits: int):
    def send(block: pa.Table) -> pa.Table:
        _, _, h, check = _block_windows(_ordered(block), size, bits)
        keys, checks, _, _ = _distinct(h, check)
        edges = C.bucket_edges(keys, len(labels))
        full = np.flatnonzero(np.diff(edges)).tolist()
        one = lambda c, t: pa.array([block[c][0].as_py()] * len(full), t)
        return pa.table(
            {
                "k": one("__k", pa.int32()),
                "t": one("__t", pa.int32()),
                "b": pa.array(full, pa.int32()),
                "r": pa.array([labels[b] for b in full], pa.int32()),
                "run": pa.array([C.pack_sorted(keys[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
                "checks": pa.array([checks[edges[b] : edges[b + 1]].astype("<u4").tobytes() for b in full], pa.binary()),
            }
        )

    return send


def _count(runs: pa.Table) -> pa.Table:
    """Merge the sorted runs of a hash range; for each run, a bit for each hash that an earlier block has too."""
    runs = runs.sort_by("t")
    keys = [C.unpack_sorted(x) for x in runs["run"].to_pylist()]
    every, check = np.concatenate(keys), np.concatenate([np.frombuffer(x, "<u4") for x in runs["checks"].to_pylist()])
    order = np.argsort(every, kind="stable")  # merges runs; equal hashes stay in block order
    same = every[order][1:] == every[order][:-1]
    if (check[order][1:] != check[order][:-1])[same].any():
        order = np.lexsort((check, every))
        same = (every[order][1:] == every[order][:-1]) & (check[order][1:] == check[order][:-1])
    later = np.zeros(len(every), dtype=bool)
    later[order[1:]] = same
    cuts = np.cumsum([0, *map(len, keys)])
    return pa.table(
        {
            "k": runs["k"].cast(pa.int32()),
            "b": runs["b"].cast(pa.int32()),
            "n": pa.array(np.diff(cuts).astype(np.int64)),
            "bits": pa.array([np.packbits(later[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


def _intervals(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _apply(size: int, cut: bool, id_type: pa.DataType, carry: list[tuple[str, pa.DataType]], bits: int):
    names = ["doc_id", "n_words", "n_removed", "intervals", "text", *[c for c, _ in carry]]
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [id_type, pa.int64(), pa.int64(), pairs, pa.string(), *[t for _, t in carry]]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def apply(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        block = _ordered(block)
        counts, starts, h, check = _block_windows(block, size, bits)
        keys, _, first, which = _distinct(h, check)
        later = np.zeros(len(keys), dtype=bool)
        if answers.num_rows:
            answers = answers.sort_by("b")
            later = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(answers["bits"].to_pylist(), answers["n"].to_pylist(), strict=True)])
        again = later[which] | (first[which] != np.arange(len(h))) if len(h) else np.zeros(0, bool)
        ends = np.concatenate(([0], np.cumsum(counts)))
        step = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
        np.add.at(step, starts[again], 1)
        np.add.at(step, starts[again] + size, -1)
        covered = np.cumsum(step)[:-1] > 0
        raw, off = C.buffers(block["__text"])
        gone = np.concatenate(([0], np.cumsum(covered)))
        gone = gone[ends[1:]] - gone[ends[:-1]]
        data, texts, spans = raw.tobytes(), [], []
        for i in range(block.num_rows):
            text = data[off[i] : off[i + 1]]
            if not gone[i]:
                spans.append([])
                texts.append(text if cut else b" ".join(text.split()))
                continue
            mask = covered[ends[i] : ends[i + 1]]
            runs = _intervals(mask)
            spans.append([{"start": a, "end": b} for a, b in runs])
            if not cut:
                words = text.split()
                texts.append(b" ".join([w for w, x in zip(words, mask.tolist(), strict=True) if not x]))
                continue
            w = C.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at : w.starts[a]])
                at = int(w.starts[b]) if b < len(w.starts) else len(text)
            texts.append(b"".join([*kept, text[at:]]))
        out = [block["__id"], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pairs), pa.array(texts, pa.binary()).cast(pa.string()), *[block[f"__c{i}"] for i in range(len(carry))]]
        return pa.table([x.cast(t) if x.type != t else x for x, t in zip(out, types, strict=True)], schema=schema)

    return apply


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cut: bool = False, carry: list[str] = (), hash_bits: int = 64) -> DataFrame:
    """Returns doc_id, n_words, n_removed, intervals (half-open ranges of removed words, maximal and ascending) and
    text: the kept words joined by one space, or with `cut` the text as it is without the removed stretches.
    Columns named in `carry` follow under their own names. `hash_bits` cuts hashes, so that tests can force collisions."""
    spark = docs.sparkSession
    n = C.blocks_of(docs)
    labels = C.even_labels(spark, n)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    kinds = [(c, slim.schema[f"__c{i}"].dataType) for i, c in enumerate(carry)]
    dealt = by_id_ranges(slim, "__id", n).withColumn("__k", C.labelled(F.col("__t"), labels)).repartition(n, "__k")
    answers = (
        dealt.groupBy("__k").applyInArrow(_send(window, labels, hash_bits), "k int, t int, b int, r int, run binary, checks binary")
        .groupBy("r").applyInArrow(_count, "k int, b int, n bigint, bits binary")
    )
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = slim.schema["__id"].dataType
    schema = SCHEMA.format(id=id_type.simpleString()) + "".join(f", `{c}` {t.simpleString()}" for c, t in kinds)
    return dealt.groupBy("__k").cogroup(answers.groupBy("k")).applyInArrow(_apply(window, cut, to_arrow_type(id_type), [(c, to_arrow_type(t)) for c, t in kinds], hash_bits), schema)
