"""Session helpers and the vectorised text kernels that the corpus operators share.

The kernels work on Arrow's own string buffers: a text is never turned into Python
strings to be split or hashed.  They run over slabs of bounded size, so memory follows
the slab (plus eight bytes a word), not the length of a document or of a batch.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelweft.session import shared_root, ship
from panelweft.sources import readers

#: Bytes of text that one pass of a kernel takes; a longer unbroken word makes one longer slab.
SLAB = 1 << 18
#: Bytes of text that operators gather from a batch before they work on it.
BLOCK = 1 << 22

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary folder is set for it on one machine; a cluster has to name one.
    """
    root = shared_root(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full[len("file:") :]  # as readers other than Hadoop's write it
    return f"{full.rstrip('/')}/panelweft-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends there, and a lost executor costs nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return readers.parquet(spark, f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give the memory that a task freed back to the system: an idle worker of a later stage holds none of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """run, a function of record batches, with release() after its last batch."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of the byte-hash base and of its inverse, grown as slabs need them."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_P, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_PINV, m, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


class Alphabet:
    """Which bytes separate words, and the value that each byte adds to a word's hash."""

    def __init__(self, separators: bytes, fold_case: bool) -> None:
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        if fold_case:
            values[65:91] = values[97:123]
        self.values = values


#: The separators of the query contracts.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
PLAIN = Alphabet(SPACES, fold_case=False)
FOLDED = Alphabet(SPACES, fold_case=True)
#: Lower-casing turns A-Z into word bytes before NOT_WORD is looked at.
ALNUM = Alphabet(bytes(b for b in NOT_WORD if not 65 <= b <= 90), fold_case=True)


class Words:
    """Words of a block: byte bounds, 64-bit hashes, and where each document's words begin."""

    __slots__ = ("bounds", "end", "hash", "prefix", "start")

    def __init__(self, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, prefix: list[np.ndarray]) -> None:
        self.start, self.end, self.hash, self.bounds, self.prefix = start, end, hashes, bounds, prefix

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def _cuts(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> list[int]:
    """Where slabs may end: at a document's end, or inside a long one at a separator."""
    cuts, at, n = [0], 0, len(data)
    while at < n:
        want = at + SLAB
        if want >= n:
            at = n
        else:
            k = int(np.searchsorted(offsets, want, side="right")) - 1
            if offsets[k] > at:
                at = int(offsets[k])
            else:
                stop = int(offsets[k + 1])
                at = want
                while at < stop:
                    gap = np.flatnonzero(~word[data[at : min(at + 4096, stop)]])
                    if len(gap):
                        at += int(gap[0]) + 1
                        break
                    at = min(at + 4096, stop)
        cuts.append(at)
    return cuts


def words_of(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, prefixes: tuple[int, ...] = ()) -> Words:
    """Split data (bytes of documents end to end, document i in offsets[i]:offsets[i+1]) into words.

    prefixes: byte lengths for which words also get the hash of their beginning (0 for shorter words).
    """
    starts, ends, hashes = [], [], []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    cuts = _cuts(data, offsets, alphabet.word)
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = data[a:b]
        word = alphabet.word[part]
        opens = np.zeros(b - a + 1, bool)
        lo, hi = np.searchsorted(offsets, [a, b])
        opens[offsets[lo:hi] - a] = True
        opens[0] = opens[-1] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | opens[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | opens[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        up, down = _POWERS.upto(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(alphabet.values[part] * up[: b - a], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h += (e - s).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(h))
        for k, head in zip(prefixes, heads, strict=True):
            at = np.minimum(s + k, e)
            head.append(np.where(e - s >= k, mix((total[at] - total[s]) * down[s] + np.uint64(k * 0x2545F4914F6CDD1D & _MASK)), 0).astype(np.uint64))
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    h = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    return Words(start, end, h, np.searchsorted(start, offsets), [np.concatenate(x) if x else none.astype(np.uint64) for x in heads])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive elements; the result has len(h) - k + 1 of them (or none)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, size, block, bsize, base = None, 0, h, 1, int(_Q)
    rest, k_left = None, k
    # Built by doubling: block covers bsize elements, out the bits of k taken so far.
    while k_left:
        if k_left & 1:
            if out is None:
                out, size = block, bsize
            else:
                n = len(h) - (bsize + size) + 1
                out = block[:n] * np.uint64(pow(base, size, 1 << 64)) + out[bsize : bsize + n]
                size += bsize
        k_left >>= 1
        if k_left:
            n = len(h) - 2 * bsize + 1
            block = block[:n] * np.uint64(pow(base, bsize, 1 << 64)) + block[bsize : bsize + n]
            bsize *= 2
    return mix(out)


def doc_grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles inside documents, and where each document's begin.

    A document of fewer words, but not none, has one: its whole sequence.
    """
    counts = w.counts
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(bounds[-1]), np.uint64)
    whole = grams(w.hash, k)
    full = counts >= k
    if full.any():
        owner = np.repeat(np.flatnonzero(full), n[full])
        inside = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n[full])])[:-1], n[full])
        out[bounds[owner] + inside] = whole[w.bounds[owner] + inside]
    for i in np.flatnonzero((counts > 0) & ~full):
        seq = w.hash[w.bounds[i] : w.bounds[i + 1]]
        out[bounds[i]] = grams(seq, len(seq))[0] ^ np.uint64(len(seq) * 0x632BE59BD9B4E019 & _MASK)
    return out, bounds


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, dat = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, name: str, size: int = BLOCK):
    """Slices of a batch whose texts together have about size bytes; at least one row each."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n places some interval covers."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:-1]) > 0
