"""Shared pieces of the training-data operators.

Word arithmetic works on the UTF-8 buffers of Arrow string arrays, so a batch of texts is tokenised and
hashed with a few numpy passes and no Python object per word. Everything here handles null texts as empty.
"""

from __future__ import annotations

import atexit
import gc
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], which separate words.
SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
#: ASCII lower case, other bytes unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER = np.frombuffer(LOWER, dtype=np.uint8)

#: Modulus and base of the Rabin-Karp polynomials: a prime, so that no pattern of words meets another by its structure.
PRIME, BASE, SECOND_BASE = (1 << 61) - 1, 0x0D6E8FEB86659FD9, 0x1B873593CC9E2D51
_U = np.uint64
_ENDS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that sums and powers of its results look random."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if not len(texts) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a batch of texts: byte ranges, 64-bit hashes, and each text's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        raw = _LOWER[raw] if lower else raw
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        sep = np.ones(n + 2, dtype=bool)
        sep[1:-1] = _IS_SPACE[raw]
        word = ~sep[1:-1]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True  # a text begins a word of its own
        self.starts = np.flatnonzero(word & (sep[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(word & (sep[2:] | edge[1:])) + 1
        self.at = np.searchsorted(self.starts, offsets)  # text i has the words at[i] .. at[i+1]

    def chunks(self) -> np.ndarray:
        """The eight bytes from each place on as an integer; places near the end see zeros."""
        padded = np.concatenate((self.raw, np.zeros(8, np.uint8)))
        return np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))

    def hashes(self, bits: int = 64) -> np.ndarray:
        """64-bit hash of every word, eight bytes at a time, each step mixed; with fewer `bits` only the leading ones."""
        at, n, view = self.starts, self.ends - self.starts, self.chunks()
        out = mix(n.astype(_U))
        rest, k = np.flatnonzero(n <= _LONG), 0
        while len(rest):
            c = view[at[rest] + k] & _ENDS[np.minimum(n[rest] - k, 8)]
            out[rest] = mix(out[rest] * _U(0x9E3779B97F4A7C15) ^ c)
            k += 8
            rest = rest[n[rest] > k]
        for i in np.flatnonzero(n > _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.raw[at[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out & _U(((1 << bits) - 1) << (64 - bits))

    def same(self, other: np.ndarray) -> bool:
        """Whether every word has the bytes of the word that `other` names for it."""
        at, to, n = self.starts, self.starts[other], self.ends - self.starts
        if not np.array_equal(n, n[other]):
            return False
        view, k = self.chunks(), 0
        rest = np.flatnonzero(at != to)
        while len(rest):
            if ((view[at[rest] + k] ^ view[to[rest] + k]) & _ENDS[np.minimum(n[rest] - k, 8)]).any():
                return False
            k += 8
            rest = rest[n[rest] > k]
        return True

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, int]:
        """(number of each word, how many): equal numbers if and only if equal bytes. Words are numbered by their hashes and then
        compared; should two different ones meet, by a dictionary."""
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self.same(first[which]):
            return which.astype(np.int64), len(first)
        data, number = self.raw.tobytes(), {}
        out = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], np.int64)
        return out, len(number)


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME for a < PRIME; the result is less than 2 * PRIME."""
    low, high = _U((1 << 31) - 1), _U(31)
    ah, al, bh, bl = a >> high, a & low, _U(b >> 31), _U(b & ((1 << 31) - 1))
    mid = ah * bl + al * bh
    t = ((ah * bh) << _U(1)) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << high) + al * bl
    return (t & _U(PRIME)) + (t >> _U(61))


def _reduced(a: np.ndarray) -> np.ndarray:
    a = (a & _U(PRIME)) + (a >> _U(61))
    return np.where(a >= _U(PRIME), a - _U(PRIME), a)


def window_starts(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """First words of the windows of `size` of n words that lie within one text."""
    if n < size:
        return np.zeros(0, np.int64)
    inside = np.ones(n - size + 1, dtype=bool)
    ends = np.asarray(at[1:-1])
    for k in range(1, size):  # a window must not begin within size-1 words before a text's end
        cut = ends - k
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    return np.flatnonzero(inside)


def windows(words: np.ndarray, at: np.ndarray, size: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes): Rabin-Karp hashes modulo PRIME of every window of `size` words that lies within one text. A window's
    polynomial is put together of those of its halves, so that no table of powers is kept."""
    starts = window_starts(len(words), at, size)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    own = _reduced(words)
    out, done, power, m = None, 0, base, 1
    while m <= size:
        if size & m:
            out, done = (own, m) if out is None else (_reduced(_times(own[: len(own) - done], pow(base, done, PRIME)) + out[m : m + len(own) - done]), done + m)
        if 2 * m <= size:
            own = _reduced(_times(own[:-m], power) + own[m:])
            power = power * power % PRIME
        m *= 2
    return starts, mix(out[starts])


def slices(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences, which the shuffle's codec then shrinks."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted uniform 64-bit keys fall apart into `buckets` equal ranges."""
    bounds = np.array([(i << 64) // buckets for i in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks_of(df: DataFrame, stored: int = 16 << 20) -> int:
    """How many blocks a table falls into: the session's shuffle partitions, or more so that a block holds about `stored` bytes
    of its files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(df.sparkSession), size // stored if size < 1 << 60 else 1)


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning deals to n different partitions, so that no task gets several blocks."""
    tries = spark.range(n * (n.bit_length() + 10)).select(F.col("id").cast("int").alias("v"))
    found = tries.groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).orderBy("p").collect()
    out = [r["v"] for r in found]
    spare = iter(range(n * (n.bit_length() + 10), 1 << 31))
    return out + [next(spare) for _ in range(n - len(out))]


def labelled(place: Column, labels: list[int]) -> Column:
    """The label of a place; a place beyond the labels has one of its own. The list is a constant of the plan."""
    known = F.get(F.split(F.lit(",".join(map(str, labels))), ","), place).cast("int")
    return F.coalesce(known, -1 - place)


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session within one process may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="loom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return base.rstrip("/")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and any executor can
    reread it. The folder goes with drop(), or else when the session's file systems close."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def drop(*stashed: DataFrame) -> None:
    """Delete tables of stash() that nothing reads any more."""
    for df in stashed:
        files, at = _folder(df.sparkSession, df.stashed_at)
        files.delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets the driver forget plans that nothing names any more; the shuffle files of their jobs then go from the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


def crc_fold(col, folds: int = 5):
    """crc32(id as text) mod folds."""
    return F.crc32(col.cast("string").cast("binary")) % folds
