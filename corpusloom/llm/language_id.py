"""Language identification by string kernels.

A text is the set of its hashed character 1- to 3-grams (lower case, every character that is no letter a space), and
the blended-spectrum presence kernel of two texts is the number of grams they share over the root of the product of
their set sizes. Nystroem landmarks (labelled texts) map a text to kernel values; one-versus-rest kernel ridge
regression weighs them. Scoring is two matrix products for a batch of texts: presence x landmarks x weights.

Fitted on a bounded sample: about SAMPLE labelled texts for each language, chosen by a hash of the id at a rate that the
exact counts of the languages fix; whole texts. The model is LANDMARKS x DIM numbers at any corpus size.

Labels only say which learned language is nearest. Whether a text is of one at all is told by `learned`: the share of its
grams (each as often as it stands) that some language's sample texts have. The bar is calibrated on sample texts held out
from the other half of the sample; texts of few grams get the slack of their standard error.

Defined cases: null texts and texts without a letter are `und` with score 0; with nothing to learn from, all are; rows
repeated or with null ids are scored one by one (a null id is never learned from nor held out); of equal scores the label that sorts
first wins; texts of any length are read whole; a table without rows gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE, LANDMARKS, DIM_BITS, GRAMS, RIDGE = 256, 128, 13, (1, 2, 3), 1e-2
UNKNOWN = "und"
#: A language has a gram if this share of its sample texts has it. The bar lies MISS times as far below 1 as the lowest LOW of held-out texts, of
#: which there must be ENOUGH; slack is ERRORS standard errors, counting one gram of each RUN as independent.
HAS, LOW, MISS, ENOUGH, ERRORS, RUN = 0.01, 0.01, 3.0, 20, 3.0, 6


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x30000)], dtype=bool)


def gram_ids(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (first text, row of each gram within the run, hashed gram, whether a text has a letter)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") < 1 << 19):
            size += len(texts[j] or "")
            j += 1
        parts = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts[i:j]]
        code = np.concatenate(parts)
        lens = np.array([len(p) for p in parts])
        row = np.repeat(np.arange(len(parts)), lens)
        letter = _letters()[np.minimum(code, 0x2FFFF)]
        has = np.bincount(row[letter], minlength=len(parts)) > 0
        code = np.where(letter, code, 32).astype(np.uint64)
        rows, grams = [], []
        for n in GRAMS:
            if len(code) < n:
                continue
            m = len(code) - n + 1
            h, any_letter = np.full(m, n, np.uint64), np.zeros(m, bool)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + code[k : k + m]
                any_letter |= letter[k : k + m]
            use = any_letter & (row[:m] == row[n - 1 : n - 1 + m])
            rows.append(row[:m][use])
            grams.append((C.mix(h[use]) >> np.uint64(64 - DIM_BITS)).astype(np.int64))
        yield i, np.concatenate(rows) if rows else row[:0], np.concatenate(grams) if grams else row[:0], has
        i = j


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(how often each text has each gram, has a letter)."""
    out, has = np.zeros((len(texts), 1 << DIM_BITS), np.float32), np.zeros(len(texts), bool)
    for at, row, gram, letters in gram_ids(texts):
        n = len(letters)
        out[at : at + n] = np.bincount((row << DIM_BITS) | gram, minlength=n << DIM_BITS).reshape(n, -1)
        has[at : at + n] = letters
    return out, has


class Known:
    """Grams of each language, and the share of known grams from which on a text is of a learned language."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.grams, self.bar = self.of(counts, labels), 0.0
        half = np.zeros(len(labels), bool)
        for k in np.unique(labels):
            half[np.flatnonzero(labels == k)[::2]] = True
        shares = [self.share(counts[~h], self.of(counts[h], labels[h]))[0] for h in (half, ~half) if h.any() and not h.all()]
        held = np.concatenate(shares) if shares else np.zeros(0)
        if len(held) >= ENOUGH:
            self.bar = max(0.0, 1.0 - MISS * (1.0 - float(np.quantile(held, LOW, method="lower"))))

    @staticmethod
    def of(counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
        rows = [(counts[labels == k] > 0).sum(0) >= max(1, np.ceil(HAS * (labels == k).sum())) for k in np.unique(labels)]
        return np.array(rows, np.float32).reshape(len(rows), counts.shape[1])

    @staticmethod
    def share(counts: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = counts.sum(1, dtype=np.float64)
        return (counts @ grams.T).max(1, initial=0) / np.maximum(n, 1), n

    def learned(self, counts: np.ndarray) -> np.ndarray:
        share, n = self.share(counts, self.grams)
        return share >= self.bar - ERRORS * np.sqrt(self.bar * (1.0 - self.bar) * RUN / np.maximum(n, 1))


class Model:
    known: Known

    def __init__(self, labels: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.labels, self.landmarks, self.weights = labels, landmarks, weights

    @staticmethod
    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Blended-spectrum presence kernel of two batches, normalised."""
        nx, ny = np.sqrt(np.maximum(x.sum(1), 1)), np.sqrt(np.maximum(y.sum(1), 1))
        return (x @ y.T) / nx[:, None] / ny[None, :]

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str]) -> Model:
        labels = sorted(set(y))
        each = max(1, LANDMARKS // max(1, len(labels)))
        of = np.array([labels.index(v) for v in y], dtype=np.int64)
        chosen = np.concatenate([np.flatnonzero(of == k)[:each] for k in range(len(labels))])[:LANDMARKS] if len(labels) else of
        marks = x[chosen]
        if not len(marks):
            return cls([], marks, np.zeros((0, 0)))
        val, vec = np.linalg.eigh(cls.kernel(marks, marks).astype(np.float64))
        root = vec / np.sqrt(np.maximum(val, 1e-6))
        phi = np.hstack([cls.kernel(x, marks).astype(np.float64) @ root, np.ones((len(x), 1))])
        target = np.where(of[:, None] == np.arange(len(labels)), 1.0, -1.0)
        weight = np.sqrt(len(of) / np.maximum(1, np.bincount(of, minlength=len(labels))))[of][:, None]
        beta = np.linalg.solve((phi * weight).T @ (phi * weight) + RIDGE * np.eye(phi.shape[1]), (phi * weight).T @ (target * weight))
        return cls(labels, marks, np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32))

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best label's index, probability-like score of it)."""
        s = self.kernel(x, self.landmarks) @ self.weights[:-1] + self.weights[-1]
        e = np.exp(4.0 * (s - s.max(1, keepdims=True)))
        return np.round(s, 6).argmax(1), 1.0 / e.sum(1)  # equal sums may differ in their last bits


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, train) -> Model:
    """Counts of labels over all training rows, then presence sets of a bounded sample of them."""
    rows = docs.where(train & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(label_col).cast("string").alias("__y"))
    counts = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    if not counts:
        return Model.fit(np.zeros((0, 1 << DIM_BITS), np.float32), [])
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE / n)))])
    place = (F.xxhash64("__id").bitwiseAND(0xFFFFF) + 0.5) / (1 << 20)
    sample = rows.where(place < rate[F.col("__y")])

    def sets(batches):
        for batch in batches:
            texts, out, often = batch["__text"].to_pylist(), *([[] for _ in range(batch.num_rows)] for _ in range(2))
            for at, row, gram, _ in gram_ids(texts):
                pairs, many = np.unique((row << DIM_BITS) | gram, return_counts=True)
                for r in np.unique(pairs >> DIM_BITS):
                    mine = (pairs >> DIM_BITS) == r
                    out[at + r], often[at + r] = (pairs[mine] & ((1 << DIM_BITS) - 1)).tolist(), many[mine].tolist()
            yield pa.RecordBatch.from_arrays([batch["__id"].cast(pa.string()), batch["__y"], pa.array(out, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], names=["id", "y", "grams", "often"])

    got = sorted(sample.mapInArrow(sets, "id string, y string, grams array<int>, often array<int>").collect(), key=lambda r: (r["id"], r["grams"]))
    x = np.zeros((len(got), 1 << DIM_BITS), np.float32)
    for i, r in enumerate(got):
        x[i, r["grams"]] = r["often"]
    y = [r["y"] for r in got]
    model = Model.fit((x > 0).astype(np.float32), y)
    model.known = Known(x, np.array([model.labels.index(v) for v in y], np.int64))
    return model


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train=None, carry: list[str] = ()) -> DataFrame:
    """Returns doc_id, lang_pred, score, learned, and the columns of `carry`; texts come back from the workers only if `carry` names
    them. `train` is the condition that marks rows to learn from; by default those whose crc32(id as text) mod 5 is not 0."""
    train = C.crc_fold(F.col(id_col)) != 0 if train is None else train
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, label_col, train))
    slim = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)], F.col(text_col).cast("string").alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                counts, has = gram_counts(part["__text"].to_pylist())
                learned = has
                if m.labels:
                    best, p = m.score((counts > 0).astype(np.float32))
                    learned = has & m.known.learned(counts)
                    pred = [m.labels[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                    p = np.where(has, p, 0.0)
                else:
                    pred, p = [UNKNOWN] * len(has), np.zeros(len(has))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(p.astype(np.float64)), pa.array(learned)], names=[*part.schema.names[:-1], "__pred", "__score", "__learned"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", __pred string, __score double, __learned boolean"
    return slim.mapInArrow(score, schema).select("doc_id", F.col("__pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__learned").alias("learned"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)])
