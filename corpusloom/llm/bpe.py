"""Byte-pair encoding with a pair occurrence index, and decoding.

A batch of texts is cut into pre-tokens; its distinct pre-tokens' symbols lie in one linked sequence. The index maps each
pair that has a rank to all its positions. Active ranks are taken in ascending order from a heap: all valid positions
of a rank are merged at once, and the pairs to the left and right of each are entered under their ranks. Each
merge touches its neighbours only, so a pre-token of any length costs n log n.

The vocabulary is read from a public tokenizer file (byte-level BPE in JSON) on the executors; its path is a parameter.

Defined cases: null texts are empty and have no ids; an added token's literal text becomes its id, as the format says;
ids that the vocabulary lacks raise ValueError on decoding; decoded bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed value: the pattern that byte-level BPE cuts pre-tokens with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts go to the index in runs of about this many bytes.
BATCH = 6 << 20


def _byte_names() -> dict[str, int]:
    """The printable character that names each byte: itself if printable Latin-1, else the next from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes | None] = [None] * size
        for token, k in vocab.items():
            self.bytes[k] = bytes(names[c] for c in token)
        for token, k in self.added.items():
            self.bytes[k] = token.encode()
        self.size = size
        self.of_byte = np.array([vocab[c] for c in sorted(names, key=names.get)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.left, self.right, self.made = (np.array([vocab[f(a, b)] for a, b in pairs], dtype=np.int32) for f in (lambda a, b: a, lambda a, b: b, str.__add__))
        code = self.left.astype(np.int64) * size + self.right
        order = np.argsort(code, kind="stable")
        self.codes, self.rank_of = code[order], order
        known = [x or b"" for x in self.bytes]
        self.blob = np.frombuffer(b"".join(known), np.uint8)
        self.cut = np.concatenate(([0], np.cumsum([len(x) for x in known])))
        self.known = np.array([x is not None for x in self.bytes])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that never merge."""
        code = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_of[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Symbols of many pre-tokens as a doubly linked sequence, with all positions of each mergeable pair by rank."""

    def __init__(self, vocab: Vocabulary, tokens: list[bytes]):
        self.v = vocab
        lens = np.array([len(t) for t in tokens], dtype=np.int64)
        ends = np.cumsum(lens)
        self.sym = vocab.of_byte[np.frombuffer(b"".join(tokens), np.uint8)] if len(tokens) else np.zeros(0, np.int32)
        n = len(self.sym)
        self.nxt, self.prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        full = lens > 0
        self.nxt[ends[full] - 1] = -1
        self.prv[(ends - lens)[full]] = -1
        self.starts = ends - lens
        self.at: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self._enter(np.flatnonzero(self.nxt >= 0))

    def _enter(self, left: np.ndarray) -> None:
        """Index the pairs that begin at these positions."""
        rank = self.v.ranks(self.sym[left], self.sym[self.nxt[left]])
        use = rank >= 0
        left, rank = left[use], rank[use]
        if len(left) < 8:
            for p, r in zip(left.tolist(), rank.tolist(), strict=True):
                self._add(r, np.array([p]))
            return
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(left, cut), strict=True):
            self._add(r, part)

    def _add(self, rank: int, places: np.ndarray) -> None:
        if rank in self.at:
            self.at[rank].append(places)
        else:
            self.at[rank] = [places]
            heapq.heappush(self.heap, rank)

    def merge_all(self) -> None:
        sym, nxt, prv = self.sym, self.nxt, self.prv
        while self.heap:
            r = heapq.heappop(self.heap)
            a, b, c = int(self.v.left[r]), int(self.v.right[r]), int(self.v.made[r])
            held = self.at.pop(r)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            p = p[(sym[p] == a) & (nxt[p] >= 0)]  # entries that an earlier merge has changed are stale
            p = p[sym[nxt[p]] == b]
            if len(held) > 1:
                p = np.unique(p)
            if a == b and len(p) > 1:  # of a run of overlapping pairs every second one, from the left
                p.sort()
                head = np.concatenate(([True], nxt[p[:-1]] != p[1:]))
                first = np.flatnonzero(head)
                p = p[(np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))) % 2 == 0]
            if not len(p):
                continue
            gone = nxt[p]
            after = nxt[gone]
            sym[p], sym[gone], nxt[p] = c, -1, after
            prv[after[after >= 0]] = p[after >= 0]
            before = prv[p]
            left = np.concatenate((before[before >= 0], p[nxt[p] >= 0]))
            if len(left):
                self._enter(np.unique(left))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens one after another, where each begins, and the end)."""
        live = self.sym >= 0
        place = np.concatenate(([0], np.cumsum(live)))
        return self.sym[live], np.append(place[self.starts], place[-1])


class Encoder:
    """Encodes texts; keeps the ids of up to `most` pre-tokens between calls."""

    def __init__(self, vocab: Vocabulary, most: int = 200_000):
        self.v, self.most = vocab, most
        self.number: dict[str, int] = {}
        self.ids, self.cut = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _parts(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of plain text, each with the id of the added token that follows it or -1."""
        at = 0
        if self.v.split and any(t in text for t in self.v.added):
            for m in self.v.split.finditer(text):
                yield text[at : m.start()], self.v.added[m[0]]
                at = m.end()
        yield text[at:] if at else text, -1

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.number) > self.most:
            self.number, self.ids, self.cut = {}, self.ids[:0], self.cut[:1]
        find, number, known, seqs = regex.compile(PATTERN).findall, self.number, len(self.number), []
        for text in texts:
            seq: list[int] = []
            for plain, added in self._parts(text) if text else ():
                seq += [number.setdefault(x, len(number)) for x in find(plain)]
                if added >= 0:
                    seq.append(-1 - added)
            seqs.append(np.array(seq, dtype=np.int32))
        fresh = [t.encode() for t, _ in zip(reversed(number), range(len(number) - known), strict=False)][::-1]
        if fresh:
            index = PairIndex(self.v, fresh)
            index.merge_all()
            ids, cut = index.ids()
            self.ids, self.cut = np.concatenate((self.ids, ids.astype(np.int32))), np.concatenate((self.cut[:-1], cut + self.cut[-1]))
        size = np.diff(self.cut)
        return [self._join(seq, size) for seq in seqs]

    def _join(self, seq: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(seq):
            return np.zeros(0, "<u4")
        plain = seq >= 0
        n = np.ones(len(seq), np.int64)
        n[plain] = size[seq[plain]]
        begin = np.cumsum(n) - n
        start = np.zeros(len(seq), np.int64)
        start[plain] = self.cut[seq[plain]]
        place = np.arange(int(n.sum())) + np.repeat(start - begin, n)
        out = self.ids[np.minimum(place, len(self.ids) - 1)].astype("<u4") if len(self.ids) else np.zeros(len(place), "<u4")
        out[begin[~plain]] = -1 - seq[~plain]
        return out


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> list[np.ndarray]:
    return Encoder(vocab)(texts)


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> str:
    ids = ids.astype(np.int64)
    if len(ids) and (ids.max() >= vocab.size or not vocab.known[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    n = vocab.cut[ids + 1] - vocab.cut[ids]
    begin = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(vocab.cut[ids], n)
    return vocab.blob[place].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Returns doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers). With `decoded`, the ids are
    decoded again in the same pass and text holds the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        encoder = Encoder(vocab)
        for batch in batches:
            _, off = C.buffers(batch["__text"])
            for a, b in C.slices(off, BATCH):
                part = batch.slice(a, b - a)
                got = encoder(part["__text"].to_pylist())
                out = [part["__id"], pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())]
                if decoded:
                    out.append(pa.array([decode_ids(x, vocab) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids", "text"][: len(out)])

    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['__id'].dataType.simpleString()}, n_tokens bigint, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Adds text, decoded from ids; the other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = [decode_ids(np.frombuffer(x or b"", "<u4"), vocab) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, text string")
