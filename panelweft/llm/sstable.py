"""Token ids in sorted-string-table shards: one file for each range of document identifiers.

A file is a magic string, data blocks, a sparse index, a Bloom filter and a footer of fixed
size.  A block holds entries (shared key length, own key length, value length, own key part,
value) in key order, each key without the prefix it shares with the one before, and is
compressed with zstd.  The index has each block's first key and place; the footer the place
of index and filter.  A lookup asks the filter, bisects the index and reads one block.
Texts are encoded by the `tokenizers` library's pre-tokeniser and BPE model, each distinct
chunk between white space once, and each distinct piece of them; plain words need no
pre-tokeniser.
Keys are order-preserving: a flag byte (0 for a null identifier) and the identifier in
big-endian with its sign bit turned.  A value is the start of the document's ids in its
shard (64 bits) and the ids, all little-endian, 32 bits each.

Null texts are empty texts; null identifiers sort first; equal identifiers are ordered by
their compressed text and each keeps its own entry; an empty table writes no file.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import bpe, ordered
from panelweft.llm import common as C
from panelweft.llm.files import opened, written

MAGIC = b"PWSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES = 1 << 18
#: Bytes of text that are encoded together, and chunks that a writing task remembers.
ENCODE_BLOCK, REMEMBERED = 1 << 20, 400_000
#: Pieces that the library's model gets in a call.
TOGETHER = 4096
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(i: int | None) -> bytes:
    return b"\x00" + bytes(8) if i is None else b"\x01" + struct.pack(">Q", (i + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<II", struct.pack("<II", zlib.crc32(key), zlib.crc32(key[::-1], 0x9E3779B9) | 1))
    return [(a + j * b) % bits for j in range(BLOOM_HASHES)]


class Writer:
    """Appends entries in key order to a stream."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES) -> None:
        self.f, self.block_bytes = stream, block_bytes
        self.f.write(MAGIC)
        self.at = len(MAGIC)
        self.z = zstandard.ZstdCompressor(level=3)
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0
        self.block, self.first, self.last, self.size = [], None, b"", 0

    def add(self, i: int | None, ids: np.ndarray) -> None:
        key = key_of(i)
        if key < (self.keys[-1] if self.keys else b""):
            raise ValueError("keys must ascend")
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        value = struct.pack("<Q", self.n_ids) + ids.astype("<u4").tobytes()
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        self.size += len(value)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        raw = self.z.compress(b"".join(self.block))
        self.f.write(raw)
        self.index.append((self.first, self.at, len(raw)))
        self.at += len(raw)
        self.block, self.first, self.size = [], None, 0

    def finish(self) -> None:
        self._flush()
        index = b"".join(k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_places(k, bits)] = True
        filter_ = np.packbits(bloom).tobytes()
        self.f.write(index)
        self.f.write(filter_)
        self.f.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.n_ids, zlib.crc32(index + filter_), MAGIC))


class Reader:
    """Looks up identifiers in one file, or scans it."""

    def __init__(self, uri: str) -> None:
        system, path = opened(uri)
        self.f = system.open_input_file(path)
        self.f.seek(self.f.size() - FOOTER.size)
        index_at, index_len, bloom_at, self.bits, self.n_docs, self.n_ids, crc, magic = FOOTER.unpack(self.f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a whole table file")
        self.f.seek(index_at)
        index, bloom = self.f.read(index_len), None
        self.f.seek(bloom_at)
        bloom = self.f.read((self.bits + 7) // 8)
        if zlib.crc32(index + bloom) != crc:
            raise ValueError(f"{uri}: index or filter is damaged")
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8))[: self.bits].astype(bool)
        rows = [index[i : i + 25] for i in range(0, index_len, 25)]
        self.first = [r[:9] for r in rows]
        self.place = [struct.unpack("<QQ", r[9:]) for r in rows]

    def close(self) -> None:
        self.f.close()

    def _entries(self, block: int):
        at, n = self.place[block]
        self.f.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.f.read(n))
        at, key = 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, struct.unpack_from("<Q", raw, at)[0], memoryview(raw)[at + 8 : at + size]
            at += size

    def get(self, i: int | None) -> np.ndarray | None:
        """The ids of the first entry of an identifier, or None."""
        key = key_of(i)
        if not self.first or not self.bloom[_places(key, self.bits)].all():
            return None
        # Equal keys may begin in the block before the one that starts with the key.
        block = max(0, bisect.bisect_left(self.first, key) - 1)
        while block < len(self.first) and self.first[block] <= key:
            for k, _, value in self._entries(block):
                if k == key:
                    return np.frombuffer(value, "<u4")
            block += 1
        return None

    def scan(self):
        """(identifier, start in the shard, bytes of the ids) in key order, one block at a time."""
        for block in range(len(self.first)):
            for key, start, value in self._entries(block):
                yield id_of(key), start, value


class LibraryEncoder(bpe.ChunkEncoder):
    """Ids as the tokenizers library gives them; a chunk that begins with a space is a special token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # The same model behind a split at spaces: many pieces in a call, and no offsets are kept.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.byte_names = np.array([*map(ord, bpe.byte_symbols())], "<u4")
        self.byte_names[ord(" ")] = ord(" ")
        vocab = self.library.get_vocab(with_added_tokens=False)
        suffix = json.loads(self.library.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        super().__init__(self._new)

    def forget(self) -> None:
        super().forget()
        self.pieces = bpe.Codes({f" {t}": k for k, t in enumerate(self.special)})
        self.piece_ids, self.piece_bounds = np.array([*self.special.values()], np.uint32), np.arange(len(self.special) + 1)

    def _tokenised(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of pieces, by the library's model."""
        ids: list[int] = []
        for at in range(0, len(pieces), TOGETHER):
            raw = np.frombuffer(" ".join(pieces[at : at + TOGETHER]).encode(), np.uint8)
            text = self.byte_names[raw].tobytes().decode("utf-32-le")
            ids += self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids
        flat = np.array(ids, np.uint32)
        bounds = np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])
        if len(bounds) != len(pieces) + 1:
            raise ValueError("a piece's last token isn't the only one that ends a word")
        return flat, bounds

    def _new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known, piece, which, sizes = len(self.pieces), self.pieces.__getitem__, [], []
        later = bpe.has_later("".join(chunks))
        add, ends = which.append, bpe.ENDS
        for c in chunks:
            # As bpe.plain_pieces() has it, without a call for each chunk.
            if not later and c.isalpha():
                add(piece(c))
                sizes.append(1)
            elif not later and c[-1] in ends and c[:-1].isalpha():
                add(piece(c[:-1]))
                add(piece(c[-1]))
                sizes.append(2)
            else:
                # Chunks are normalised; a second time might compose letters that became lower case.
                own = [c] if c[0] == " " else [c[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(c)]
                which += map(piece, own)
                sizes.append(len(own))
        if len(self.pieces) > known:
            ids, bounds = self._tokenised(list(islice(self.pieces, known, None)))
            self.piece_bounds = np.concatenate([self.piece_bounds, bounds[1:] + len(self.piece_ids)])
            self.piece_ids = np.concatenate([self.piece_ids, ids])
        flat, total = bpe.taken(self.piece_ids, self.piece_bounds, np.array(which, np.int64))
        return flat, total[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])]

    chunks, _plain = bpe.PairIndexEncoder.chunks, bpe.PairIndexEncoder._plain


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are Spark's to deal out
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, path: str, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, n_shards: int | None = None) -> DataFrame:
    """Encode docs into one file for each identifier range under path.

    Returns the manifest (shard, path, n_docs, n_ids), stored beside the files: it names the
    files of the tasks that finished, and no others.
    """
    spark = docs.sparkSession
    C.ship(spark)
    names = vocabulary or bpe.default_vocabulary()
    n = n_shards or C.width(spark)
    cuts = ordered.bounds(docs, id_col, n)
    rows = ordered.dealt(ordered.packed(docs, id_col, text_col, cuts), max(n, len(cuts) + 1)).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        own = encoder(names)
        own.remembered = REMEMBERED
        state: list = [None, None, None, None]  # shard, context, writer, uri

        def close():
            shard, context, writer, uri = state
            if writer is None:
                return None
            writer.finish()
            context.__exit__(None, None, None)
            state[:] = [None, None, None, None]
            return C.batch_of(schema, [shard], [uri], [len(writer.keys)], [writer.n_ids])

        try:
            for batch in batches:
                for part in C.blocks(batch, "text", ENCODE_BLOCK):
                    texts = [t.decode() for t in ordered.unpacked(C.column(part, "text"))]
                    ids, bounds = own.encode([own.chunks(t) for t in texts])
                    for j, (shard, i) in enumerate(zip(C.column(part, "shard").to_pylist(), C.column(part, "id").to_pylist(), strict=True)):
                        if shard != state[0]:
                            if (done := close()) is not None:
                                yield done
                            uri = f"{path}/shard-{shard:06d}.sst"
                            context = written(uri)
                            state[:] = [shard, context, Writer(context.__enter__()), uri]
                        state[2].add(i, np.append(ids[bounds[j] : bounds[j + 1]], np.uint32(end_id)))
            if (done := close()) is not None:
                yield done
        except BaseException as e:
            if state[1] is not None:
                state[1].__exit__(type(e), e, e.__traceback__)
            raise

    return C.stored(rows.mapInArrow(C.tidy(run), "shard int, path string, n_docs long, n_ids long"), f"{path}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the manifest's files; start counts over all shards in order."""
    spark = manifest.sparkSession
    files = sorted((r["shard"], r["path"], r["n_ids"]) for r in manifest.collect())  # one row a shard
    base, rows = 0, []
    for _, path, n_ids in files:
        rows.append((path, base))
        base += n_ids
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(path)
                out: list = []
                for i, start, value in reader.scan():
                    out.append((i, base + start, len(value) // 4, zlib.crc32(value)))
                    if len(out) == 4096:
                        yield C.batch_of(schema, *map(list, zip(*out, strict=True)))
                        out = []
                if out:
                    yield C.batch_of(schema, *map(list, zip(*out, strict=True)))
                reader.close()

    return spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows))).mapInArrow(C.tidy(run), "id long, start long, n_tokens long, ids_crc32 long")


def op8_sstable(spark, sf_dir: str) -> DataFrame:
    """Writes the shards of documents and reads them back."""
    manifest = write_shards(C.table(spark, sf_dir, "documents"), C.shared_dir(spark))
    return read_shards(manifest).withColumnRenamed("id", "doc_id")
