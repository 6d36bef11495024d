"""N-gram Jaccard join: every link between sets of word shingles at or above a threshold, as components.

Sets with equal members are one node. Sizes fall into bands; for a band, the universe of shingles is cut by hash
into segments so many that two similar sets, which differ in at most H shingles, must agree on one (pigeonhole). A segment
of weight one is indexed by its subset; one of weight two also by its subset's one-deletion neighbourhood, and so stands
one difference. Weights sum to H + 1 + spare. Segments that are empty in a set carry no information and would meet
everywhere: a set leaves out its empty ones if there are at most `spare`, else none, which loses no link (see
`Allocation`). How many segments of each weight and how much spare a band gets is the cheapest by a cost model of
rows emitted and chance candidates, given the number of sets in the band.

Keys travel as packed runs, one for each batch and range of keys. Of a batch's sets with one key the least stands for all, so a
key that a third of all sets have is one entry for each batch; a range meets those and the least of them leads. So each key has a
tree: sets, leaders of batches, leader of the key.

A set's sketch is the parity of the number of its shingles in each of SKETCH hashed places (and of WIDE, for pairs that these do
not tell apart): a shingle that two sets do not share turns one place, so sketches never differ in more places than the sets in
shingles, and pairs whose sketches differ too much are no links. The rest is verified on the words themselves. A set is first compared with the leader that it
meets most often, then with its leaders of other components. Keys whose sets are still in several components get ROUNDS more
leaders, drawn by a hash of key and set, with which their sets of other components are compared; so a dense group whose sets link to
some of each other soon is one component, at one row for each key and set; a round without a link is the last. Keys of two sets, which
have met, and keys that have the sets of another take no part in this. The sets that are left share a passage more often than they link,
so they are not paired by key: each sends its rarest shingles, one more than a linked set may lack (a prefix in one order for
all sets), and those that share one where room for a link is left are compared across components, each pair once. The order comes from
counts in PLACES hashed places; it decides how many sets meet, not which links are found. So no link between different components is missed.

Exactness: sizes and verified links come from words that are numbered by hash and compared byte by byte. Hashes of shingles only
make candidates: equal shingles have equal hashes, so linked sets differ in no more hashes than shingles. Equal sequences of words
are one node, named by a 128-bit BLAKE2b digest; nodes that agree in its first 64 bits, which stand for them in runs, are candidates.

Defined cases: texts of fewer words than a shingle are one shingle (the whole sequence); null and blank texts are
empty sets, linked with nothing; null ids never name a component unless it has no other; repeated rows are copies; texts of any
length are read whole (slices of 512 KB, a longer text is a slice); a table without rows gives none; other columns, whatever their
names, are ignored; of equally frequent leaders the greatest is compared first, which no result depends on. Only A-Z are lower-cased.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .filters import MASK_BITS, mask_of

#: Cost model: what the verification of a chance candidate costs in rows, and how often two sets share a given shingle by chance.
CANDIDATE_COST, CHANCE = 2000.0, 1e-4
SKETCH, WIDE = 256, 2048
#: Leaders drawn for keys in several components before what is left meets by its rarest shingles.
ROUNDS = 3
#: Places in which shingles are counted, to be ordered, and the stretches of them that are summed apart.
PLACES, STRETCHES = 1 << 20, 16
#: Keys that a batch holds before it sends them, and that a range of keys shall have.
BATCH_KEYS, RANGE_KEYS = 1 << 19, 1 << 20
_SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]


@dataclass(frozen=True)
class Threshold:
    """Sets link when den * intersection >= num * union."""

    num: int = 90
    den: int = 100

    def differences(self, sizes: int) -> int:
        """The most differing shingles that linked sets of that many shingles together can have."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def bands(self, most: int) -> list[int]:
        """Lower ends of the size bands up to `most`: linked sets lie in one band or in two neighbours."""
        ratio, ends = max(1.5, 1.02 * self.den / self.num), [1]
        while ends[-1] <= most:
            ends.append(int(ends[-1] * ratio) + 1)
        return ends


@dataclass(frozen=True)
class Allocation:
    """A band's segments: `single` of weight one, `double` of weight two (twice as wide), and the spare weight.

    Two linked sets differ in at most H places, so with weights summing to H + 1 + spare at least one segment has fewer
    differences than its weight even if `spare` single segments are set aside. Segments set aside are empty in both
    sets. If either set has at most `spare` empty single segments, at most so many are lost; if both have more,
    neither leaves out any."""

    single: int
    double: int
    spare: int

    @property
    def segments(self) -> int:
        return self.single + self.double


def allocate(h: int, size: float, sets: int) -> Allocation:
    """The cheapest allocation for `sets` sets of which the smallest, with the most empty segments, have `size` shingles."""
    best, found = math.inf, Allocation(h + 1, 0, 0)
    for spare in range(0, h // 2 + 3, 1 + h // 64):
        units = h + 1 + spare
        for double in sorted({0, units // 8, units // 4, units // 2}):
            single = units - 2 * double
            mean = size / (single + 2 * double)
            empty = math.exp(-mean)
            expect = single * empty
            tail = 0.5 * math.erfc((spare + 0.5 - expect) / math.sqrt(2 * expect + 1e-12))  # more empty ones than spare
            rows = single + double * (1 + 2 * mean)
            few = (1 + 2 * mean) * math.exp(-2 * mean)  # a double segment of one shingle at most
            alone = size * CHANCE * empty**2  # a shingle in common by chance, alone in its segment in both
            chance = alone + tail**2 * min(1.0, single * empty**2) + double * few * (few + 2 * mean * CHANCE)
            cost = rows + CANDIDATE_COST * sets * chance
            if cost < best:
                best, found = cost, Allocation(single, double, spare)
    return found


@lru_cache(4096)
def _salt(band: int, segments: int) -> np.ndarray:
    return C.mix(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 32))


def signatures(shingles: np.ndarray, band: int, a: Allocation) -> np.ndarray:
    """Keys of a set in a band's scheme."""
    content, place = C.mix(shingles ^ np.uint64(0xA5A5A5A5)), C.mix(shingles ^ np.uint64(0x5EED5EED00))
    slot = (((place >> np.uint64(32)) * np.uint64(a.single + 2 * a.double)) >> np.uint64(32)).astype(np.int64)
    segment = np.where(slot < a.single, slot, a.single + (slot - a.single) // 2)
    sums, count = np.zeros(a.segments, np.uint64), np.bincount(segment, minlength=a.segments)
    np.add.at(sums, segment, content)
    salt = _salt(band, a.segments)
    keys = C.mix(sums + salt)
    hollow = np.flatnonzero(count[: a.single] == 0)
    if 0 < len(hollow) <= a.spare:
        keys = np.delete(keys, hollow)
    if a.double:
        wide = segment >= a.single
        keys = np.concatenate((keys, C.mix(sums[segment[wide]] - content[wide] + salt[segment[wide]])))
    return keys


class Shingles:
    """Word shingles of a slice of texts: exact sizes, and the hashes of the distinct ones text by text (cut[i] .. cut[i+1])."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, size: int, bits: int = 64):
        w = C.Words(raw, offsets, lower=True)
        h, texts = w.hashes(bits), len(offsets) - 1
        number, kinds = w.ids(h)
        starts, hashes = C.windows(h, w.at, size)
        of = np.searchsorted(w.at, starts, side="right") - 1
        exact = exact_windows(number, kinds, starts, size)
        _, first = np.unique(of * (int(exact.max()) + 1 if len(exact) else 1) + exact, return_index=True)
        self.n = np.bincount(of[first], minlength=texts)
        self.cut = np.concatenate(([0], np.cumsum(self.n)))
        self.hashes = hashes[first] & np.uint64(((1 << bits) - 1) << (64 - bits))
        few = np.diff(w.at)
        self.short = (few > 0) & (few < size)
        self.n[self.short] = 1

    def sketches(self, places: int) -> np.ndarray:
        """Parity of the number of shingles in each of so many places, as 64-bit integers."""
        out = np.zeros((len(self.n), places // 64), np.int64)
        place = (C.mix(self.hashes ^ np.uint64(0xB17B17B17)) % np.uint64(places)).astype(np.int64)
        for i, (a, b) in enumerate(zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True)):
            out[i] = np.packbits((np.bincount(place[a:b], minlength=places) & 1).astype(np.uint8)).view("<i8")
        return out


def exact_windows(number: np.ndarray, kinds: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Small numbers of the windows of `size` words at `starts`: equal if and only if the windows' words are."""
    out, most = number[starts], kinds
    for k in range(1, size):
        if most * kinds >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            most = int(out.max()) + 1 if len(out) else 1
        out, most = out * kinds + number[starts + k], most * kinds
    return np.unique(out, return_inverse=True)[1].astype(np.int64)


def sliced(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = C.buffers(texts)
    for i, j in C.slices(off):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def canonical(raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Each text's lower-cased words joined by one space."""
    data = raw.tobytes().translate(C.LOWER)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield b" ".join(data[a:b].split())


def digest(text: bytes, bits: int = 64) -> tuple[int, int]:
    """128-bit digest as two integers; with fewer `bits` the first has only its leading ones."""
    d = hashlib.blake2b(text, digest_size=16).digest()
    a = int.from_bytes(d[:8], "big") >> (64 - bits) << (64 - bits)
    return a - (a >> 63 << 64), int.from_bytes(d[8:], "big", signed=True)


def _describe(words: int, bits: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size, digest and sketch of each text's set."""
        for batch in batches:
            for i, j, raw, off in sliced(batch["__text"]):
                sets = Shingles(raw, off, words, bits)
                named = [digest(x, bits) if x else (None, None) for x in canonical(raw, off)]
                sk, wide = sets.sketches(SKETCH), sets.sketches(WIDE)
                places = pa.array(np.arange(j - i + 1, dtype=np.int32) * (WIDE // 64))
                yield pa.RecordBatch.from_arrays(
                    [batch["__id"].slice(i, j - i), pa.array(sets.n, pa.int64()), *[pa.array([x[k] for x in named], pa.int64()) for k in (0, 1)], *[pa.array(sk[:, k]) for k in range(len(_SKETCHES))], pa.ListArray.from_arrays(places, pa.array(wide.ravel()))],
                    names=["id", "n", "d1", "d2", *_SKETCHES, "wide"],
                )

    return describe


_RUN = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("node", pa.binary()), ("lead", pa.binary()), ("names", pa.binary())])


def _runs(keys: np.ndarray, owner: np.ndarray, names: np.ndarray, parts: int, turn: int) -> pa.RecordBatch:
    """Runs of a batch's (key, set): to the key's range goes the least set of each key; the others, with it, to any range."""
    order = np.argsort(keys, kind="stable")  # owners are numbered by ascending name, and keys of one set are distinct
    keys, owner = keys[order], owner[order]
    head = np.concatenate(([True], keys[1:] != keys[:-1]))
    lead = owner[np.flatnonzero(head)[np.cumsum(head) - 1]]
    rows = []

    def run(part: int, k: np.ndarray, o: np.ndarray, led: np.ndarray | None) -> None:
        used, place = np.unique(np.concatenate((o, led)) if led is not None else o, return_inverse=True)
        place = place.astype("<u2")
        rows.append((part, C.pack_sorted(k), place[: len(o)].tobytes(), place[len(o) :].tobytes() if led is not None else None, names[used].astype("<i8").tobytes()))

    first, rest = np.flatnonzero(head), np.flatnonzero(~head)
    edges = C.bucket_edges(keys[first], parts)
    for p in np.flatnonzero(np.diff(edges)).tolist():
        at = first[edges[p] : edges[p + 1]]
        run(p, keys[at], owner[at], None)
    for a in range(0, len(rest), 1 << 14):
        at = rest[a : a + (1 << 14)]
        run((turn + a) % parts, keys[at], owner[at], lead[at])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)


def _index(words: int, t: Threshold, schemes: dict[int, Allocation], ends: list[int], parts: int, bits: int):
    """Runs of the keys of sets."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, held, seen, many = np.array(ends), {}, set(), 0

        def flush() -> pa.RecordBatch:
            names = sorted(held)
            keys = [held[k] for k in names]
            return _runs(np.concatenate(keys), np.repeat(np.arange(len(names)), [len(k) for k in keys]), np.array(names, np.int64), parts, abs(names[0]) % parts)

        for batch in batches:
            for _, _, raw, off in sliced(batch["__text"]):
                sets = Shingles(raw, off, words, bits)
                for i, text in enumerate(canonical(raw, off)):
                    if not text or sets.short[i]:
                        continue  # a sequence of its own: only equal ones link
                    both = digest(text, bits)
                    if both in seen:
                        continue
                    seen.add(both)
                    name = both[0]
                    n, s = int(sets.n[i]), sets.hashes[sets.cut[i] : sets.cut[i + 1]]
                    own, got = int(np.searchsorted(lower, n, side="right")) - 1, []
                    for band in (own, own + 1):
                        if band in schemes and (band == own or t.den * n >= t.num * ends[band]):
                            got.append(signatures(s, band, schemes[band]))
                    if got:
                        held[name] = np.unique(np.concatenate([*got, *([held[name]] if name in held else [])]))
                        many += len(held[name])
                    if many >= BATCH_KEYS or len(held) >= 1 << 15:
                        yield flush()
                        held, seen, many = {}, set(), 0
        if held:
            yield flush()

    return index


def _meet(rows: pa.Table) -> pa.Table:
    """(key, x, lead) of a range of keys: each set that a batch sent and the key's least one, and what batches led themselves."""
    keys, names, out = [], [], []
    for r in rows.to_batches():
        for k, o, led, n in zip(*(r[c].to_pylist() for c in ("keys", "node", "lead", "names")), strict=True):
            k, o, n = C.unpack_sorted(k), np.frombuffer(o, "<u2"), np.frombuffer(n, "<i8")
            if led is None:
                keys.append(k)
                names.append(n[o])
            else:
                out.append((k, n[o], n[np.frombuffer(led, "<u2")]))
    if keys:
        k, n = np.concatenate(keys), np.concatenate(names)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        twin = k[1:] == k[:-1]
        many = np.flatnonzero(np.concatenate((twin, [False])) | np.concatenate(([False], twin)))
        k, n = k[many], n[many]
        if len(k):
            head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            least = np.repeat(np.minimum.reduceat(n, head), np.diff(np.append(head, len(k))))
            other = np.flatnonzero(n != least)
            pairs = np.unique(np.stack((k[other].view(np.int64), n[other], least[other])), axis=1)
            out.append((pairs[0].view(np.uint64), pairs[1], pairs[2]))
    cat = lambda i: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64)
    return pa.table({"key": pa.array(cat(0).view(np.int64), pa.int64()), "x": pa.array(cat(1), pa.int64()), "lead": pa.array(cat(2), pa.int64())})


def _fetch(shared, bits: int):
    """Digests and packed words of the texts whose digest the mask has."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for _, _, raw, off in sliced(batch["__text"]):
                found = {}
                for text in canonical(raw, off):
                    if text:
                        d = digest(text, bits)
                        at = (d[0] >> (64 - MASK_BITS)) & ((1 << MASK_BITS) - 1)
                        if mask[at >> 3] >> (7 - (at & 7)) & 1 and d not in found:
                            found[d] = len(text).to_bytes(4, "little") + pa.compress(text, "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in found], pa.int64()) for k in (0, 1)] + [pa.array(list(found.values()), pa.binary())], names=["d1", "d2", "body"])

    return fetch


def _unpack(bodies: list[bytes]) -> list[bytes]:
    return [pa.decompress(b[4:], int.from_bytes(b[:4], "little"), "zstd", asbytes=True) for b in bodies]


def compare(left: list[bytes], right: list[bytes], words: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(size of the intersection, of the union) of the shingle sets of each pair of texts."""
    texts = [t for pair in zip(left, right, strict=True) for t in pair]
    w = C.Words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    number, kinds = w.ids(w.hashes(bits))
    starts = C.window_starts(len(number), w.at, words)
    of = np.searchsorted(w.at, starts, side="right") - 1
    shingle = exact_windows(number, kinds, starts, words)
    span = int(shingle.max()) + 1 if len(shingle) else 1
    u = np.unique((of // 2 * span + shingle) * 2 + of % 2)
    pair = u // 2 // span
    both = np.flatnonzero(u[1:] // 2 == u[:-1] // 2)
    common = np.bincount(pair[both], minlength=len(left))
    return common, np.bincount(pair, minlength=len(left)) - common


def _unpacked(bodies: pa.Array, words: int, bits: int, most: int = 1 << 19) -> Iterator[tuple[int, int, Shingles]]:
    """Sets of packed texts i to j, about `most` bytes at a time."""
    lens = np.array([int.from_bytes(b.as_py()[:4], "little") for b in bodies], np.int64)
    for i, j in C.slices(np.concatenate(([0], np.cumsum(lens))), most):
        raw = np.frombuffer(b"".join(_unpack(bodies.slice(i, j - i).to_pylist())), np.uint8)
        yield i, j, Shingles(raw, np.concatenate(([0], np.cumsum(lens[i:j]))), words, bits)


def _places(hashes: np.ndarray) -> np.ndarray:
    return (C.mix(hashes ^ np.uint64(0xC0FFEE)) % np.uint64(PLACES)).astype(np.int64)


def _count(words: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles of a task's texts in each place, by stretches."""
        own = np.zeros(PLACES, "<i8")
        for batch in batches:
            for _, _, sets in _unpacked(batch["body"], words, bits):
                np.add.at(own, _places(sets.hashes), 1)
        for s, part in enumerate(np.split(own, STRETCHES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["stretch", "counts"])

    return count


def _sum(rows: pa.Table) -> pa.Table:
    total = np.zeros(PLACES // STRETCHES, "<i8")
    for b in rows["counts"]:
        total += np.frombuffer(pa.decompress(b.as_py(), total.nbytes, "zstd", asbytes=True), "<i8")
    return pa.table({"stretch": rows["stretch"].slice(0, 1), "counts": pa.array([_levels(total).tobytes()], pa.binary())})


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in eighths of a doubling, a byte each."""
    return np.minimum(255, 8 * np.log2(1 + counts)).astype(np.uint8)


def prefix(sets: Shingles, levels: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, shingle, rank) of the rarest shingles of each set, as many as linked sets must share one of."""
    of = np.repeat(np.arange(len(sets.n)), np.diff(sets.cut))
    order = np.lexsort((sets.hashes, levels[_places(sets.hashes)], of))
    h, n = sets.hashes[order], np.diff(sets.cut)[of]
    rank = np.arange(len(h)) - sets.cut[of]
    fresh = np.ones(len(h), bool)  # shingles with one hash count as often as they are, and meet by the first
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    use = np.flatnonzero(fresh & (rank <= n + (-t.num * n // t.den)))
    return of[use], h[use], rank[use]


def _prefixes(words: int, t: Threshold, bits: int, shared):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for i, _, sets in _unpacked(batch["body"], words, bits):
                of, h, rank = prefix(sets, levels, t)
                at = pa.array(of + i)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch["node"].take(at), batch["root"].take(at), pa.array(sets.n[of].astype(np.int32)), pa.array(rank.astype(np.int32))], names=["shingle", "node", "root", "n", "rank"])

    return prefixes


def _verify(words: int, t: Threshold, bits: int, most: int = 1 << 19):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = np.array([int.from_bytes(v.as_py()[:4], "little") for c in ("bx", "by") for v in batch[c]]).reshape(2, -1).sum(0)
            for i, j in C.slices(np.concatenate(([0], np.cumsum(lens))), most):
                part = batch.slice(i, j - i)
                common, union = compare(_unpack(part["bx"].to_pylist()), _unpack(part["by"].to_pylist()), words, bits)
                use = pa.array(np.flatnonzero(t.den * common >= t.num * union))
                yield pa.RecordBatch.from_arrays([part["x"].take(use), part["y"].take(use)], names=["a", "b"])

    return verify


class _Search:
    """What the steps of a join share: the texts, the nodes (d1, d2, node, least, n, sketch), and the threshold."""

    def __init__(self, slim: DataFrame, nodes: DataFrame, words: int, t: Threshold, bits: int):
        self.slim, self.nodes, self.words, self.t, self.bits = slim, nodes, words, t, bits

    def side(self, name: str) -> DataFrame:
        return self.nodes.select(*[F.col(c).alias(f"{c}_{name}") for c in ("d1", "d2", "node", "n", *_SKETCHES)])

    def close(self):
        """Whether sizes and sketches of x and y leave room for a link; false only for pairs that are none."""
        t, x, y = self.t, F.col("n_x"), F.col("n_y")
        apart = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in _SKETCHES), F.lit(0))
        return (F.least(x, y) * t.den >= F.greatest(x, y) * t.num) & (apart * (t.den + t.num) <= (x + y) * (t.den - t.num))

    def closer(self, pairs: DataFrame) -> DataFrame:
        """Pairs (node_x, node_y) that the wide sketches leave too."""
        t, out = self.t, pairs
        for side in ("x", "y"):
            out = out.join(self.nodes.select(F.col("node").alias(f"node_{side}"), F.col("n").alias(f"size_{side}"), F.col("wide").alias(f"wide_{side}")), f"node_{side}")
        apart = F.aggregate(F.zip_with("wide_x", "wide_y", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("int")), F.lit(0), lambda a, b: a + b)
        return out.where(apart * (t.den + t.num) <= (F.col("size_x") + F.col("size_y")) * (t.den - t.num)).select(pairs.columns)

    def texts(self, ends: DataFrame) -> DataFrame:
        """Packed words (d1, d2, body) of the nodes with these digests d1, and of some others."""
        mask = self.slim.sparkSession.sparkContext.broadcast(mask_of(ends, "d1"))
        return self.slim.select("__text").mapInArrow(_fetch(mask, self.bits), "d1 bigint, d2 bigint, body binary").groupBy("d1", "d2").agg(F.first("body").alias("body"))

    def links(self, pairs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """Verified links (a, b) of pairs (node_x, node_y and their digests). A text moves once, and once more for each pair
        that has it as x; texts of the corpus that are in no pair do not move."""
        texts = self.texts(pairs.select(F.explode(F.array("d1_x", "d1_y")).alias("d1"))) if texts is None else texts
        named = lambda side: texts.select(F.col("d1").alias(f"d1_{side}"), F.col("d2").alias(f"d2_{side}"), F.col("body").alias(f"b{side}"))
        slim = pairs.select("d1_x", "d2_x", "d1_y", "d2_y", F.col("node_x").alias("x"), F.col("node_y").alias("y"))
        both = slim.join(named("x"), ["d1_x", "d2_x"]).join(named("y"), ["d1_y", "d2_y"])
        return C.stash(both.select("x", "y", "bx", "by").mapInArrow(_verify(self.words, self.t, self.bits), "a bigint, b bigint"), "links")

    def rest(self, ends: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs (node_x, node_y) of different components that share one of their rarest shingles and may link: of the nodes `ends`
        (node, root) all that link are among them."""
        t = self.t
        summed = texts.mapInArrow(_count(self.words, self.bits), "stretch int, counts binary").groupBy("stretch").applyInArrow(_sum, "stretch int, counts binary").collect()  # a byte a place
        levels = {r["stretch"]: bytes(r["counts"]) for r in summed}
        shared = self.slim.sparkSession.sparkContext.broadcast(b"".join(levels.get(s, bytes(PLACES // STRETCHES)) for s in range(STRETCHES)))
        bodies = texts.join(ends.join(self.nodes.select("d1", "d2", "node"), "node"), ["d1", "d2"]).select("node", "root", "body")
        tokens = bodies.mapInArrow(_prefixes(self.words, t, self.bits, shared), "shingle bigint, node bigint, root bigint, n int, rank int")
        same = Window.partitionBy("shingle")
        tokens = C.stash(tokens.withColumn("r", F.min("root").over(same)).withColumn("s", F.max("root").over(same)).where("r <> s").drop("r", "s"), "rarest")
        side = lambda name: tokens.toDF(*[c if c == "shingle" else f"{c}_{name}" for c in tokens.columns])
        x, y = F.col("n_x").cast("bigint"), F.col("n_y").cast("bigint")
        room = (F.least(x, y) * t.den >= F.greatest(x, y) * t.num) & (F.least(x - F.col("rank_x"), y - F.col("rank_y")) * (t.den + t.num) >= (x + y) * t.num)
        pairs = C.stash(side("x").join(side("y"), "shingle").where("node_x > node_y AND root_x <> root_y").where(room).select("node_x", "node_y").distinct(), "rest")
        C.drop(tokens)
        return pairs


def _joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    """Components with further links."""
    out = linked if more.isEmpty() else components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    C.drop(more)
    return out


def _roots(df: DataFrame, column: str, of: DataFrame, name: str) -> DataFrame:
    """Adds the component of a node; nodes without a link are their own."""
    return df.join(of.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _undecided(there: DataFrame) -> DataFrame:
    """The keys (of key, d1) that still have pairs to compare: those of two sets have none, as one of them led the other, and
    of keys with the same sets, told by 128 bits of hashes beside their number and ends, the least stands for all."""
    told = [F.count(F.lit(1)).alias("sets"), F.min("d1").alias("a"), F.max("d1").alias("b"), F.bit_xor(F.xxhash64("d1")).alias("h"), F.bit_xor(F.xxhash64("d1", F.lit(1))).alias("g")]
    return there.groupBy("key").agg(*told).where("sets > 2").groupBy("sets", "a", "b", "h", "g").agg(F.min("key").alias("key")).select("key")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100, hash_bits: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least id reachable by links). `hash_bits` cuts
    hashes, so that tests can force collisions."""
    t = Threshold(num, den)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    id_type = slim.schema["__id"].dataType.simpleString()
    ends = t.bands(1 << 40)
    band = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("n"))) - 1
    described = C.stash(slim.mapInArrow(_describe(words, hash_bits), f"id {id_type}, n bigint, d1 bigint, d2 bigint, " + ", ".join(f"{c} bigint" for c in _SKETCHES) + ", wide array<bigint>"), "described")
    grouped = described.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("n", *_SKETCHES, "wide")])
    nodes = C.stash(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    schemes: dict[int, Allocation] = {}
    held = {r["band"]: (r["sets"], r["size"]) for r in nodes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("sets"), F.avg("n").alias("size")).collect()}
    for k in held:
        schemes[k] = allocate(t.differences(2 * (ends[k + 1] - 1)), max(1.0, t.num * ends[k] / t.den), held[k][0])
    rows = sum(2 * held[k][0] * (a.single + a.double * (1 + 2 * held[k][1] / (a.single + 2 * a.double))) for k, a in schemes.items())
    parts = max(C.partitions(docs.sparkSession), int(rows // RANGE_KEYS) + 1)
    search = _Search(slim, nodes, words, t, hash_bits)
    run = "part int, keys binary, node binary, lead binary, names binary"
    met = C.stash(slim.select("__text").mapInArrow(_index(words, t, schemes, ends, parts, hash_bits), run).groupBy("part").applyInArrow(_meet, "key bigint, x bigint, lead bigint"), "met")
    # Each set against the leader that it meets most often, then against its others of other components.
    pairs = met.groupBy(F.col("x").alias("d1_x"), F.col("lead").alias("d1_y")).count()
    if not nodes.groupBy("d1").count().where("count > 1").isEmpty():
        pairs = pairs.unionByName(nodes.select(F.col("d1").alias("d1_x"), F.col("d1").alias("d1_y"), F.lit(1).cast("bigint").alias("count")).distinct())
    near = pairs.join(search.side("x"), "d1_x").join(search.side("y"), "d1_y").where("node_x <> node_y").where(search.close()).select("node_x", "node_y", "d1_x", "d2_x", "d1_y", "d2_y", "count")
    near = C.stash(search.closer(near), "near")
    nearest = near.groupBy("node_x", "d1_x", "d2_x").agg(F.max(F.struct("count", "node_y", "d1_y", "d2_y")).alias("best")).select("node_x", "d1_x", "d2_x", "best.node_y", "best.d1_y", "best.d2_y")
    found = search.links(nearest)
    linked = components(found)
    C.drop(found)
    C.release(docs.sparkSession)
    other = C.stash(_roots(_roots(near.drop("count"), "node_x", linked, "rx"), "node_y", linked, "ry").where("rx <> ry").select(near.drop("count").columns), "other")
    if not other.isEmpty():
        linked = _joined(linked, search.links(other))
    C.drop(other, near)
    pairs = near = nearest = found = other = grouped = None
    C.release(docs.sparkSession)
    # Keys whose sets are still in several components: these sets across components.
    named = _roots(nodes.select("node", "d1"), "node", linked, "root").groupBy("d1").agg(F.min("root").alias("root"), F.max("root").alias("last"))
    split = met.join(named.select(F.col("d1").alias("x"), F.col("root").alias("rx"), F.col("last").alias("lx")), "x").join(named.select(F.col("d1").alias("lead"), F.col("root").alias("ry"), F.col("last").alias("ly")), "lead").where("rx <> ry OR rx <> lx OR ry <> ly").select("key").distinct()
    there = C.stash(met.join(split, "key", "left_semi").select("key", F.explode(F.array("x", "lead")).alias("d1")).distinct(), "there")
    C.drop(met)
    named = split = met = None
    C.release(docs.sparkSession)
    kept = C.stash(there.join(_undecided(there), "key", "left_semi"), "there")
    C.drop(there)
    there = kept
    if not there.isEmpty():
        columns = ["node_x", "node_y", "d1_x", "d2_x", "d1_y", "d2_y"]
        sets = C.stash(there.join(nodes.select("d1", "node"), "d1").select("key", "node"), "sets")
        texts = C.stash(search.texts(there.select("d1")), "texts")
        C.drop(there)
        last = ROUNDS
        for k in range(ROUNDS + 1):
            rooted = _roots(sets, "node", linked, "root")
            several = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max(F.struct(F.xxhash64("key", "node", F.lit(k)), "node", "root")).alias("drawn")).where("r <> s")
            open_ = C.stash(rooted.join(several.select("key", F.col("drawn.node").alias("drawn"), F.col("drawn.root").alias("of")), "key"), "open")
            C.drop(sets)
            sets = open_.select("key", "node")  # the keys still open are all that a later round reads
            sets.stashed_at = open_.stashed_at
            if open_.isEmpty():
                break
            if k < last:  # every set against the one drawn for its key; sizes and sketches come to pairs, not to sets
                drawn = open_.where("root <> of").select(F.col("node").alias("node_x"), F.col("drawn").alias("node_y")).distinct()
            else:
                drawn = rare = search.rest(open_.select("node", "root").distinct(), texts)
            cross = drawn.join(search.side("x"), "node_x").join(search.side("y"), "node_y").where(search.close()).select(columns)
            cross = C.stash(search.closer(cross), "cross")
            before = linked
            if not cross.isEmpty():
                linked = _joined(linked, search.links(cross, texts))
            C.drop(cross)
            if k == last:
                C.drop(rare)
                break
            last = k + 1 if linked is before else last
            rooted = several = open_ = None
            C.release(docs.sparkSession)
        C.drop(sets, texts)
    else:
        C.drop(there)
    least = linked.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(least, "root").select("node", "component")
    of = nodes.select("d1", "d2", "least", "node").join(named, "node", "left").select("d1", "d2", F.coalesce("component", "least").alias("component"))
    out = described.select("id", "n", "d1", "d2").join(of, ["d1", "d2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
