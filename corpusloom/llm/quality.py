"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features are word 1- and 2-grams, the same of the words' shapes (letters, capitals, digits and signs, runs
collapsed), and one for a word that equals the word before it; each hashed into 2**BITS places. A feature's value is its share
among the grams of its kind, so texts of any length compare, and a score is a sparse dot product: the mean weight of a
text's grams of each kind, added up.

Trained on a bounded sample of SAMPLE labelled texts (those with the smallest hashes of their ids), whole texts. The model
is 2**BITS numbers at any corpus size.

Defined cases: null texts are empty; an empty text gets the bias alone; rows with null ids are scored, never learned
from nor held out; an id with several labels gives one example for each; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE, BITS, EPOCHS, KINDS = 4096, 18, 3, 5
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2e-3, 1e-3
SCALE = 8.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def _shapes(w: C.Words) -> np.ndarray:
    """Hash of each word's shape with runs collapsed."""
    shape = _SHAPE[w.raw]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[w.starts] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    v = C.Words.__new__(C.Words)
    v.raw, v.starts, v.ends = shape[keep], place[w.starts], place[w.ends]
    return v.hashes()


def features(w: C.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of gram: (text of each gram, its hashed place)."""
    text = np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))
    h, s = w.hashes(), _shapes(w)
    two = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    place = lambda x, kind: (C.mix(x + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)
    pair = lambda x: x[two] * np.uint64(3) + x[two + 1]
    same = (h[two] == h[two + 1]).astype(np.uint64)
    return [(text, place(h, 1)), (text[two], place(pair(h), 2)), (text, place(s, 3)), (text[two], place(pair(s), 4)), (text[two], place(same, 5))]


class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] += g * g


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = C.buffers(batch["__text"])
        at, val = [], []
        for i in range(batch.num_rows):
            w = C.Words(raw[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
            row: dict[int, float] = {}
            for _, place in features(w):
                u, c = np.unique(place, return_counts=True)
                for k, v in zip(u.tolist(), (c * (SCALE / max(1, len(place)))).tolist(), strict=True):
                    row[k] = row.get(k, 0.0) + v
            at.append(np.array(list(row), "<i4").tobytes())
            val.append(np.array(list(row.values()), "<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch["__id"], batch["__y"], pa.array(at, pa.binary()), pa.array(val, pa.binary())], names=["id", "y", "at", "val"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train) -> np.ndarray:
    """Weights (the last is the bias) learned from a bounded sample of the labelled rows that `train` marks."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train)
        .select(F.col(id_col).cast("string").alias("__k"), F.col(label_col).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__k"), "__k", "__y").limit(SAMPLE)
    )
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), F.col("__id") == F.col("__k"))
    got = rows.select("__id", "__y", "__text").mapInArrow(_sparse, "id string, y int, at binary, val binary").collect()
    got.sort(key=lambda r: (r["id"], r["y"], r["at"]))
    model, bias = FTRL(), 1 << BITS
    examples = [(np.append(np.frombuffer(r["at"], "<i4"), bias), np.append(np.frombuffer(r["val"], "<f4"), 1.0).astype(np.float64), r["y"]) for r in got]
    order = np.random.default_rng(7).permutation(len(examples))
    for _ in range(EPOCHS):
        for k in order:
            model.update(*examples[k])
    return model.weights()


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train=None) -> DataFrame:
    """Returns doc_id and score (0 to 1, the probability of label 1). `train` is a condition on labels; by default rows
    whose crc32(id as text) mod 5 is not 0 are learned from."""
    train = C.crc_fold(F.col(id_col)) != 0 if train is None else train
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, train))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            raw, off = C.buffers(batch["__text"])
            total = np.full(batch.num_rows, weights[-1])
            for i, j in C.slices(off, 1 << 20):
                w = C.Words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for text, place in features(w):
                    sums, grams = np.bincount(text, weights[place], minlength=j - i), np.bincount(text, minlength=j - i)
                    total[i:j] += SCALE * sums / np.maximum(1, grams)
            yield pa.RecordBatch.from_arrays([batch["__id"], pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(score, f"doc_id {slim.schema['__id'].dataType.simpleString()}, score double")
