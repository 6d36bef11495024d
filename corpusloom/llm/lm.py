"""Language-model scoring: a causal self-attention model over subword ids, and a unigram base over words.

Counting: each task counts the words (and their subwords) of the training texts it reads; sorted runs go to hash ranges,
where they merge into one table of counts that grows with the corpus. Its totals, and the counts of subword ids (bounded
by the vocabulary), come to the driver.

Model: subword ids fall into CLASSES clusters (k-means on neighbour profiles, which count the neighbours of every id in all
training texts); one causal self-attention layer and a feed-forward layer predict the class of the next id. Within its class an id has the
share that it has in all training texts after ids of the group of the id before it (GROUPS clusters of the same profiles), so that
the table of shares grows with the vocabulary alone: GROUPS x ids in half precision, 26 MB for 50k ids. Weights start from SAMPLE
training texts on the driver. Then every training text is learned from once: texts are dealt by a hash into ROUNDS rounds and each
round's into groups of texts; each takes Adam steps over all its windows from the weights of the round before, and the weights are
averaged, by their windows. A word's probability is the mean of the attention model's and of its smoothed share of all words.

Scoring: texts are dealt into blocks; a block asks the ranges for the counts of its distinct words (one key for each word
and block, however frequent), gets them back, and scores its texts (blocks are as many as the shuffle partitions, or more where one would
hold over 16 MB of files, and each is dealt to a partition of its own): each id is scored once, in windows of STRIDE new ids
that see the STRIDE ids before them, by batched masked attention.

Defined cases: null texts are empty and consist of the end alone; rows with null ids are learned from as not held out only
if their fold says so (a null fold is neither); repeated rows are scored and counted one by one; texts of any length are scored whole,
a long one makes its block longer; a table without rows gives none; other columns, whatever their names, are ignored. Words are
known by 64-bit hashes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE, CLASSES, GROUPS, WIDTH, HIDDEN, STRIDE, ROWS, STEPS, BATCH = 512, 16, 256, 16, 16, 16, 4096, 400, 128
#: Neighbours that a profile counts on each side; passes of averaging, the rate of each, and pieces in which weights are averaged.
BESIDE, ROUNDS, RATES, PIECES = 192, 2, (0.003, 0.001), 16
#: Weight of an id's share of its class in its share after the class of the id before it, in counts.
PRIOR = 8.0
#: Share of the attention component in the probability of a word; the rest is the word's smoothed share of the corpus.
MIX = 0.5
LN10 = float(np.log(10.0))


class Subwords:
    """Subword ids of words by a public rank file; words are encoded with a leading space, as they stand in a text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.spaced = np.zeros(self.size, bool)
        for token, k in ranks.items():
            self.spaced[k] = token[:1] == b" "
        self.coder = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's begin, and the end)."""
        one = self.coder.encode_ordinary
        got = [one(" " + w) for w in words]
        cut = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int64)
        return np.fromiter((k for x in got for k in x), np.int64, int(cut[-1])), cut


@lru_cache(2)
def subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


class Vocabulary:
    """Distinct words of some texts: sorted hashes, counts, place of each word, and the words' bytes."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        raw, off = C.buffers(texts)
        hashes, firsts, self.per_text = [], [], []
        data = []
        for i, j in C.slices(off):
            w = C.Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
            h = w.hashes()
            u, first = np.unique(h, return_index=True)
            lower = w.raw.tobytes()
            data += [lower[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
            firsts.append(u)
            hashes.append(h)
            self.per_text.append(np.diff(w.at))
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        some = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
        self.keys, self.which, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.per_text = np.concatenate(self.per_text) if self.per_text else np.zeros(0, np.int64)
        at = np.unique(some, return_index=True)[1] if len(some) else np.zeros(0, np.int64)
        self.words = [data[k].decode("utf-8", "replace") for k in at.tolist()]


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


_RUNS = "part int, keys binary, counts binary, ids binary, texts bigint, h bigint, seq binary"


def _runs(vocab: str, pattern: str, parts: int):
    """Sorted runs of counts for each range (part), and with part -1 each text's ids."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("texts", pa.int64()), ("h", pa.int64()), ("seq", pa.binary())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(vocab, pattern)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = Vocabulary(batch["__text"])
            ids, cut = coder.encode(v.words)
            use = np.bincount(ids, np.repeat(v.counts, np.diff(cut)), minlength=coder.size).astype(np.int64)
            use[coder.end] = batch.num_rows
            edges = C.bucket_edges(v.keys, parts)
            slots = [coder.size * p // parts for p in range(parts + 1)]
            rows = [
                (p, C.pack_sorted(v.keys[edges[p] : edges[p + 1]]), C.pack_counts(v.counts[edges[p] : edges[p + 1]]), C.pack_counts(use[slots[p] : slots[p + 1]]), batch.num_rows if p == 0 else 0, None, None)
                for p in range(parts)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            n = batch.num_rows
            ids, lens = _ids_of(v, n, ids, cut, coder.end)
            raw, at = ids.astype(_id_type(coder.size)), np.concatenate(([0], np.cumsum(lens))).tolist()
            seq = pa.array([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            blank = [pa.nulls(n, f.type) for f in list(schema)[1:5]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), *blank, batch["__h"], seq], schema=schema)

    return runs


def _join(seqs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each)."""
    kind = np.dtype(_id_type(size))
    return np.frombuffer(b"".join(seqs), kind).astype(np.int64), np.array([len(x) // kind.itemsize for x in seqs], np.int64)


def _beside(slot: np.ndarray, parts: int):
    """Counts of each id's neighbours on both sides among the BESIDE most frequent ids, over the texts of a task."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    size, wide = len(slot), 2 * BESIDE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size * wide, np.uint32)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                ids, _ = _join(batch["seq"].slice(a, 1024).to_pylist(), size)
                for mine, other, shift in ((ids[:-1], ids[1:], 0), (ids[1:], ids[:-1], BESIDE)):
                    ok = slot[other] >= 0
                    np.add.at(found, mine[ok] * wide + slot[other[ok]] + shift, np.uint32(1))
        keys = np.flatnonzero(found).astype(np.uint64)
        counts = found[keys.astype(np.int64)]
        edges = np.searchsorted(keys, np.array([size * wide * p // parts for p in range(parts + 1)], np.uint64))
        full = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([C.pack_sorted(keys[edges[p] : edges[p + 1]]) for p in full], pa.binary()), pa.array([C.pack_counts(counts[edges[p] : edges[p + 1]]) for p in full], pa.binary())], schema=schema)

    return count


def _after(groups: np.ndarray, parts: int):
    """Counts of each id after an id of each group (the end's before a text's first), over the texts of a task."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    size, end = len(groups), len(groups) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(GROUPS * size, np.uint32)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                ids, _ = _join(batch["seq"].slice(a, 1024).to_pylist(), size)
                before = groups[np.concatenate(([end], ids[:-1]))]  # texts close with the end
                np.add.at(found, before * size + ids, np.uint32(1))
        keys = np.flatnonzero(found).astype(np.uint64)
        counts = found[keys.astype(np.int64)]
        edges = np.searchsorted(keys, np.array([GROUPS * size * p // parts for p in range(parts + 1)], np.uint64))
        full = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([C.pack_sorted(keys[edges[p] : edges[p + 1]]) for p in full], pa.binary()), pa.array([C.pack_counts(counts[edges[p] : edges[p + 1]]) for p in full], pa.binary())], schema=schema)

    return count


def shares(classes: np.ndarray, counts: np.ndarray, after: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """within of a model: an id's smoothed share of its class after each group of the id before it."""
    size = len(classes)
    total = np.bincount(classes, counts + 0.5, minlength=CLASSES)
    plain = (counts + 0.5) / total[classes]
    out, row = np.zeros((GROUPS, size), np.float16), np.zeros(size)
    for g, (a, b) in enumerate(zip(*(np.searchsorted(after[0], (np.arange(GROUPS) + k) * size) for k in (0, 1)), strict=True)):
        row[:] = 0
        row[after[0][a:b] - g * size] = after[1][a:b]
        seen = np.bincount(classes, row, minlength=CLASSES)
        out[g] = np.log((row + PRIOR * plain) / (seen[classes] + PRIOR))
    return out


def _sum_beside(rows: pa.Table) -> pa.Table:
    keys = np.concatenate([C.unpack_sorted(x) for x in rows["keys"].to_pylist()])
    counts = np.concatenate([C.unpack_counts(x).astype(np.int64) for x in rows["counts"].to_pylist()])
    keys, which = np.unique(keys, return_inverse=True)
    return pa.table({"keys": pa.array([C.pack_sorted(keys)], pa.binary()), "counts": pa.array([np.bincount(which, counts, minlength=len(keys)).astype("<i8").tobytes()], pa.binary())})


def _sum(rows: pa.Table) -> pa.Table:
    """One range of the count table: merged keys with summed counts, its totals, and its slice of subword counts."""
    keys = np.concatenate([C.unpack_sorted(x) if x else np.zeros(0, np.uint64) for x in rows["keys"].to_pylist()])
    counts = np.concatenate([C.unpack_counts(x).astype(np.int64) for x in rows["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[head], np.add.reduceat(counts, head) if len(head) else counts
    ids = sum(C.unpack_counts(x).astype(np.int64) for x in rows["ids"].to_pylist())
    return pa.table(
        {
            "part": pa.array([rows["part"][0].as_py()], pa.int32()),
            "keys": pa.array([C.pack_sorted(keys)], pa.binary()),
            "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "tokens": pa.array([int(counts.sum())], pa.int64()),
            "types": pa.array([len(keys)], pa.int64()),
            "texts": pa.array([sum(rows["texts"].to_pylist())], pa.int64()),
        }
    )


class Model:
    """One causal self-attention layer and a feed-forward layer over embeddings of ids, with classes as outputs."""

    def __init__(self, rng: np.random.Generator, rows: np.ndarray, classes: np.ndarray, groups: np.ndarray, within: np.ndarray):
        """within[g, id]: log share of an id in its class after an id of group g."""
        self.rows, self.classes, self.groups, self.within = rows.astype(np.int32), classes.astype(np.int32), groups.astype(np.int32), within
        d, f = WIDTH, np.float32
        put = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(f)
        self.p = {"emb": (rng.standard_normal((ROWS, d)) * 0.5).astype(f), "pos": (rng.standard_normal((2 * STRIDE, d)) * 0.1).astype(f), "q": put(d, d), "k": put(d, d), "v": put(d, d), "o": put(d, d), "w1": put(d, HIDDEN), "b1": np.zeros(HIDDEN, f), "w2": put(HIDDEN, d), "u": put(d, CLASSES), "bias": np.zeros(CLASSES, f)}
        n = 2 * STRIDE
        self.seen = (np.arange(n)[None, :] <= np.arange(STRIDE)[:, None] + STRIDE).astype(f)

    @classmethod
    def like(cls, other: Model, p: dict) -> Model:
        """The same classes and rows with other weights."""
        out = cls.__new__(cls)
        out.rows, out.classes, out.groups, out.within, out.seen, out.p = other.rows, other.classes, other.groups, other.within, other.seen, p
        return out

    def prepare(self) -> None:
        """Products of weights that scoring needs: scores are own @ (q k') @ x', contexts a @ x @ (v o)."""
        p = self.p
        self.qk = (p["q"] @ p["k"].T / np.sqrt(WIDTH)).astype(np.float32)
        self.vo = (p["v"] @ p["o"]).astype(np.float32)

    def log_probs(self, tokens: np.ndarray, real: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target id: the layers with fused weights. Exponents
        are clipped far above what the weights can reach, in place of subtracting a maximum."""
        p, s, d = self.p, STRIDE, WIDTH
        n = len(tokens)
        x = p["emb"].take(self.rows[tokens], 0) + p["pos"]
        own = np.ascontiguousarray(x[:, s:]).reshape(-1, d)
        a = (own @ self.qk).reshape(n, s, d) @ x.transpose(0, 2, 1)
        np.minimum(a, 80.0, out=a)
        np.exp(a, out=a)
        a *= self.seen
        part = np.flatnonzero(~real[:, 0])  # windows whose first places do not exist
        if len(part):
            a[part] *= real[part, None, :]
        c = (a @ x).reshape(-1, d)
        c /= a.sum(-1).reshape(-1, 1)
        h = own + c @ self.vo
        r = h @ p["w1"]
        r += p["b1"]
        np.maximum(r, 0, out=r)
        h += r @ p["w2"]
        y = h @ p["u"]
        y += p["bias"]
        np.minimum(y, 80.0, out=y)
        flat = target.ravel()
        got = y[np.arange(len(y)), self.classes[flat]] + self.within[self.groups[tokens[:, s:]].ravel(), flat]
        np.exp(y, out=y)
        return (got - np.log(y.sum(-1))).reshape(n, s)

    def gradients(self, tokens: np.ndarray, real: np.ndarray, target: np.ndarray, use: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the targets that exist, and its gradients. Scores and contexts go by the fused weights."""
        p, s, d = self.p, STRIDE, WIDTH
        n, scale = len(tokens), 1.0 / np.sqrt(WIDTH).astype(np.float32)
        row = self.rows[tokens]
        x = p["emb"].take(row, 0) + p["pos"]
        own = np.ascontiguousarray(x[:, s:]).reshape(-1, d)
        qk, vo = (p["q"] @ p["k"].T) * scale, p["v"] @ p["o"]
        xt = x.transpose(0, 2, 1)
        t = (own @ qk).reshape(n, s, d)
        a = t @ xt
        np.minimum(a, 80.0, out=a)
        np.exp(a, out=a)
        a *= self.seen
        part = np.flatnonzero(~real.all(1))
        if len(part):
            a[part] *= real[part, None, :]
        a /= np.maximum(a.sum(-1, keepdims=True), 1e-30)
        c = (a @ x).reshape(-1, d)
        h = own + c @ vo
        r = np.maximum(h @ p["w1"] + p["b1"], 0)
        e = h + r @ p["w2"]
        y = e @ p["u"]
        y += p["bias"]
        y -= y.max(-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(-1, keepdims=True)
        at, cls, use = np.arange(len(y)), self.classes[target].ravel(), use.ravel()
        many = max(1, int(use.sum()))
        loss = float(-(np.log(y[at, cls] + 1e-9) * use).sum() / many)
        y[at, cls] -= 1
        y *= (use / many).astype(np.float32)[:, None]
        g = {"u": e.T @ y, "bias": y.sum(0)}
        de = y @ p["u"].T
        g["w2"] = r.T @ de
        dz = (de @ p["w2"].T) * (r > 0)
        g["w1"], g["b1"] = h.T @ dz, dz.sum(0)
        dh = de + dz @ p["w1"].T
        dvo = c.T @ dh
        g["v"], g["o"] = dvo @ p["o"].T, p["v"].T @ dvo
        dc = (dh @ vo.T).reshape(n, s, d)
        ds = dc @ xt
        ds -= (dc.reshape(-1, d) * c).sum(-1).reshape(n, s, 1)
        ds *= a
        dt = (ds @ x).reshape(-1, d)
        dqk = own.T @ dt * scale
        g["q"], g["k"] = dqk @ p["k"], dqk.T @ p["q"]
        dx = a.transpose(0, 2, 1) @ dc
        dx += ds.transpose(0, 2, 1) @ t
        dx[:, s:] += (dh + dt @ qk.T).reshape(n, s, d)
        g["pos"] = dx.sum(0)
        flat, dx = row.ravel(), dx.reshape(-1, d)
        g["emb"] = np.stack([np.bincount(flat, dx[:, k], minlength=ROWS) for k in range(d)], 1).astype(p["emb"].dtype)
        return loss, g


class Adam:
    def __init__(self, p: dict):
        self.p, self.step = p, 0
        self.m, self.v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def move(self, g: dict, rate: float) -> None:
        self.step += 1
        for k, w in self.p.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.99 * self.v[k] + 0.01 * g[k] ** 2
            w -= (rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)


def cut_windows(ids: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts of ids that end in `end`: (input ids, which exist, targets, which exist), in text
    order. The input at a target's place is the id before it; before the first stands `end`."""
    s = STRIDE
    padded = -(-lens // s) * s
    begin = np.cumsum(padded + s) - (padded + s)  # each text: STRIDE places of nothing, then its ids, padded
    size = int((padded + s).sum())
    target, input_ = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(begin + s, lens)
    target[place] = ids
    input_[place[1:]] = ids[:-1]
    input_[begin + s] = end
    n = padded // s
    first = np.repeat(begin, n) + s * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    at = first[:, None] + np.arange(2 * s)
    x, y = input_[at], target[at[:, s:]]
    return np.maximum(x, 0), x >= 0, np.maximum(y, 0), y >= 0


def cluster(beside: tuple[np.ndarray, np.ndarray], coder_spaced: np.ndarray, counts: np.ndarray, end: int, kinds: int = CLASSES) -> np.ndarray:
    """Which of `kinds` classes each id is in: k-means on the neighbours that ids seen often enough have in all training texts, given as places
    in a matrix of ids by neighbours and their counts; the others by whether they begin a word; the end has its own."""
    size = len(counts)
    out = np.where(coder_spaced, 0, 1).astype(np.int64)
    out[end] = 2
    often = np.flatnonzero((counts >= 4) & (np.arange(size) != end))
    if len(often) > kinds:
        line = np.full(size, -1)
        line[often] = np.arange(len(often))
        wide = 2 * BESIDE
        place, many = beside
        mine = line[place // wide]
        prof = np.zeros((len(often), wide), np.float32)
        prof[mine[mine >= 0], (place % wide)[mine >= 0]] = many[mine >= 0]
        np.sqrt(prof, out=prof)
        prof /= np.maximum(1e-9, np.linalg.norm(prof, axis=1, keepdims=True))
        k = kinds - 3
        centre = prof[np.argsort(-counts[often], kind="stable")[:k]]
        weight = np.sqrt(counts[often]).astype(np.float32)[:, None]
        for _ in range(10):
            near = (prof @ centre.T).argmax(1)
            for c in range(k):
                if (near == c).any():
                    centre[c] = (prof[near == c] * weight[near == c]).sum(0)
            centre /= np.maximum(1e-9, np.linalg.norm(centre, axis=1, keepdims=True))
        out[often] = 3 + near
    return out


def top_slots(counts: np.ndarray) -> np.ndarray:
    """Slot of each of the BESIDE most frequent ids, and -1 for the others."""
    slot = np.full(len(counts), -1)
    top = np.argsort(-counts, kind="stable")[:BESIDE]
    slot[top] = np.arange(len(top))
    return slot


def begin(ids: np.ndarray, lens: np.ndarray, counts: np.ndarray, classes: np.ndarray, groups: np.ndarray, within: np.ndarray, end: int) -> Model:
    """Model from the counts over all training texts; its first weights are fitted to the ids given."""
    rng = np.random.default_rng(11)
    rows = classes.copy()
    top = np.argsort(-counts, kind="stable")[: ROWS - CLASSES]
    rows[top] = CLASSES + np.arange(len(top))
    model = Model(rng, rows, classes, groups, within)
    model.prepare()
    if not len(lens):
        return model
    x, real, y, use = cut_windows(ids, lens, end)
    freq = np.bincount(classes[y[use]], minlength=CLASSES) + 0.5
    model.p["bias"] = np.log(freq / freq.sum()).astype(np.float32)
    adam = Adam(model.p)
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(x), BATCH)
        _, g = model.gradients(x[pick], real[pick], y[pick], use[pick])
        adam.move(g, 0.01 * min(1.0, step / 20) * (1.0 - 0.9 * step / STEPS))
    model.prepare()
    return model


def _learn(shared, rate: float, size: int, end: int):
    """Weights after Adam steps over every window of a group's texts, in PIECES, each times the number of windows."""

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("seq", "ascending")])
        model: Model = shared.value
        model = Model.like(model, {k: w.copy() for k, w in model.p.items()})
        ids, lens = _join(rows["seq"].to_pylist(), size)
        bounds, adam, rng, seen = np.concatenate(([0], np.cumsum(lens))), Adam(model.p), np.random.default_rng(5), 0
        for i, j in C.slices(bounds, 1 << 18):
            x, real, y, use = cut_windows(ids[bounds[i] : bounds[j]], lens[i:j], end)
            order = rng.permutation(len(x))
            for a in range(0, len(x), 2 * BATCH):
                pick = order[a : a + 2 * BATCH]
                _, g = model.gradients(x[pick], real[pick], y[pick], use[pick])
                adam.move(g, rate * min(1.0, (adam.step + 1) / 20) * len(pick) / (2 * BATCH))
            seen += len(x)
        flat = np.concatenate([w.ravel() for w in model.p.values()]).astype(np.float64) * seen
        return pa.table({"piece": pa.array(np.arange(PIECES, dtype=np.int32)), "windows": pa.array([seen] * PIECES, pa.int64()), "sum": pa.array([x.astype("<f4").tobytes() for x in np.array_split(flat, PIECES)], pa.binary())})

    return learn


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in sorted(rows["sum"].to_pylist()))
    return pa.table({"piece": pa.array([rows["piece"][0].as_py()], pa.int32()), "windows": pa.array([sum(rows["windows"].to_pylist())], pa.int64()), "sum": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def fit(seqs: DataFrame, counts: np.ndarray, coder: Subwords, n: int) -> Model:
    """Model from the ids (h, seq) of all training texts."""
    spark = seqs.sparkSession

    def gathered(count) -> tuple[np.ndarray, np.ndarray]:
        found = seqs.select("seq").mapInArrow(count, "part int, keys binary, counts binary").groupBy("part").applyInArrow(_sum_beside, "keys binary, counts binary").collect()
        place = np.concatenate([C.unpack_sorted(r["keys"]) for r in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        many = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in found]) if found else place
        order = np.argsort(place, kind="stable")
        return place[order], many[order]

    beside = gathered(_beside(top_slots(counts), n))
    classes, groups = (cluster(beside, coder.spaced, counts, coder.end, k) for k in (CLASSES, GROUPS))
    within = shares(classes, counts, gathered(_after(groups, n)))
    first = sorted(bytes(r["seq"]) for r in seqs.orderBy("h", "seq").limit(SAMPLE).select("seq").collect())
    model = begin(*_join(first, coder.size), counts, classes, groups, within, coder.end)
    deal = F.pmod(F.shiftright("h", 8), F.lit(n)).cast("int")
    for k in range(ROUNDS if first else 0):
        shared = spark.sparkContext.broadcast(model)
        mine = seqs.where(F.pmod("h", F.lit(ROUNDS)) == k).select(deal.alias("g"), "h", "seq")
        learned = mine.groupBy("g").applyInArrow(_learn(shared, RATES[k], coder.size, coder.end), "piece int, windows bigint, sum binary")
        sums = sorted(learned.groupBy("piece").applyInArrow(_add, "piece int, windows bigint, sum binary").collect(), key=lambda r: r["piece"])
        if sums:
            flat, p, at = np.concatenate([np.frombuffer(r["sum"], "<f8") / r["windows"] for r in sums]), {}, 0
            for name, w in model.p.items():
                p[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
                at += w.size
            model = Model.like(model, p)
    model.prepare()
    return model


def _ids_of(v: Vocabulary, texts: int, ids: np.ndarray, cut: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each closed by the end, number of ids of each), from the ids of the distinct words."""
    v.ids_per_word = np.diff(cut)
    n = v.ids_per_word[v.which]
    text = np.repeat(np.arange(texts), v.per_text)
    lens = np.bincount(text, n, minlength=texts).astype(np.int64) + 1
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[:-1][v.which], n)
    out = np.full(int(lens.sum()), end, np.int64)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(lens) - 1] = True
    out[~is_end] = ids[place]
    return out, lens


def _ask(parts: int):
    def ask(block: pa.Table) -> pa.Table:
        v = Vocabulary(block["__text"])
        edges = C.bucket_edges(v.keys, parts)
        full = np.flatnonzero(np.diff(edges))
        return pa.table({"t": pa.array([block["__t"][0].as_py()] * len(full), pa.int32()), "part": pa.array(full.astype(np.int32)), "run": pa.array([C.pack_sorted(v.keys[edges[p] : edges[p + 1]]) for p in full], pa.binary())})

    return ask


_ANSWER = pa.schema([("t", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _answer(asked: pa.Table, table: pa.Table) -> pa.Table:
    if not asked.num_rows:
        return _ANSWER.empty_table()
    keys = C.unpack_sorted(table["keys"][0].as_py()) if table.num_rows and table["keys"][0].as_py() else np.zeros(0, np.uint64)
    counts = np.frombuffer(table["counts"][0].as_py(), "<i8") if table.num_rows else np.zeros(0, np.int64)
    out = []
    for run in asked["run"].to_pylist():
        k = C.unpack_sorted(run)
        at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
        out.append((np.where(keys[at] == k, counts[at], 0) if len(keys) else np.zeros(len(k))).astype("<i8").tobytes())
    return pa.table([asked["t"].cast(pa.int32()), asked["part"].cast(pa.int32()), pa.array(out, pa.binary())], schema=_ANSWER)


def _score(vocab: str, pattern: str, shared, total: int, types: int, ends: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    unit = np.log10(total + 0.5 * (types + 1))

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        n, coder, model = block.num_rows, subwords(vocab, pattern), shared.value
        v = Vocabulary(block["__text"])
        c = np.concatenate([np.frombuffer(x, "<i8") for x in answers.sort_by("part")["counts"].to_pylist()]) if answers.num_rows else np.zeros(0, np.int64)
        text = np.repeat(np.arange(n), v.per_text)
        known = np.bincount(text, (c > 0)[v.which], minlength=n).astype(np.int64) + (ends > 0)
        ids, lens = _ids_of(v, n, *coder.encode(v.words), coder.end)
        bounds, parts = np.concatenate(([0], np.cumsum(lens))), []
        for i, j in C.slices(bounds, 1 << 18):
            x, real, y, use = cut_windows(ids[bounds[i] : bounds[j]], lens[i:j], coder.end)
            for a in range(0, len(x), 64):
                part = slice(a, a + 64)
                parts.append(model.log_probs(x[part], real[part], y[part])[use[part]])
        # Tokens (each text's words and its end): how many ids each has, and its log10 probability by either component.
        tokens, last = len(v.which) + n, np.cumsum(v.per_text + 1) - 1
        size, plain, is_word = np.ones(tokens, np.int64), np.full(tokens, np.log10(ends + 0.5) - unit), np.ones(tokens, bool)
        is_word[last] = False
        size[is_word], plain[is_word] = v.ids_per_word[v.which], (np.log10(c + 0.5) - unit)[v.which]
        attended = np.add.reduceat(np.concatenate(parts).astype(np.float64), np.cumsum(size) - size) / LN10
        high = np.maximum(plain, attended)
        mixed = high + np.log10(MIX * 10.0 ** (attended - high) + (1 - MIX) * 10.0 ** (plain - high))
        of = np.repeat(np.arange(n), v.per_text + 1)
        base, score = (np.bincount(of, x, minlength=n) for x in (plain, mixed))
        return pa.table([block["__id"], pa.array(v.per_text + 1, pa.int64()), pa.array(known), pa.array(base), pa.array(score)], schema=schema)

    return score


def score_texts(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", train=None) -> DataFrame:
    """Returns doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities). `train` is the condition
    that marks rows to learn from; by default those whose crc32(id as text) mod 5 is not 1."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    n = C.partitions(spark)
    train = C.crc_fold(F.col(id_col)) != 1 if train is None else train
    view = lambda d: d.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    slim, learn = view(docs), view(docs.where(train))
    id_type = slim.schema["__id"].dataType
    raw = C.stash(learn.select(F.xxhash64("__id", "__text").alias("__h"), "__text").mapInArrow(_runs(vocab_path, pattern, n), _RUNS), "training-ids")
    runs = raw.where("part >= 0").select("part", "keys", "counts", "ids", "texts")
    table = C.stash(runs.groupBy("part").applyInArrow(_sum, "part int, keys binary, counts binary, ids binary, tokens bigint, types bigint, texts bigint"), "word-counts")
    totals = table.select("part", "ids", "tokens", "types", "texts").orderBy("part").collect()
    texts = sum(r["texts"] for r in totals)
    total, types = sum(r["tokens"] for r in totals) + texts, sum(r["types"] for r in totals) + (texts > 0)
    coder = subwords(vocab_path, pattern)
    counts = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in totals]) if totals else np.zeros(coder.size, np.int64)
    shared = spark.sparkContext.broadcast(fit(raw.where("part < 0").select("h", "seq"), counts, coder, n))
    blocks = C.blocks_of(docs)
    place = F.pmod(F.xxhash64("__id", "__text"), F.lit(blocks)).cast("int")
    dealt = slim.withColumn("__t", C.labelled(place, C.even_labels(spark, blocks))).repartition(blocks, "__t")
    asked = dealt.groupBy("__t").applyInArrow(_ask(n), "t int, part int, run binary")
    answers = asked.groupBy("part").cogroup(table.select("part", "keys", "counts").groupBy("part")).applyInArrow(_answer, "t int, part int, counts binary")
    scored = dealt.groupBy("__t").cogroup(answers.groupBy("t")).applyInArrow(
        _score(vocab_path, pattern, shared, total, types, texts, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))
