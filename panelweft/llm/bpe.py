"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a block are laid out as one linked list of symbols.  An index maps
each adjacent pair to all its positions in the partition's words; the ranks of the pairs
that occur are active, kept in a heap and applied in ascending order.  Applying a rank
merges all its positions at once (left to right where they overlap) and only the pairs
beside a merged position are looked up again and appended to the index.

Ascending order over all words gives each word the merges it would get alone, because no
merge of the file uses a token that a later merge makes; `Vocabulary` checks that.

Null texts are empty texts; empty texts have no ids; repeated rows are encoded alike; texts
of any length are encoded whole; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelweft.llm import common as C

#: The white space of Unicode, the file's pre-tokeniser pattern (without case: it is applied to lower case).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Letters and numbers of later Unicode versions than the tokenizers library's, which are symbols to it.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Capitals that this Python's tables don't lower yet, and the library's do: first, last, first small letter.
CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
_LOWER = {a + i: low + i for a, b, low in CAPITALS for i in range(b - a + 1)}
_CAPITAL = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in CAPITALS) + "]")
_LATER = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in LATER)
PIECES = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|[[^{WHITE}\p{{L}}\p{{N}}]||[{_LATER}]]+")
_LATER_SYMBOL = regex.compile(f"[{_LATER}]")
#: Punctuation that ends a word and is a piece of its own; an apostrophe may begin a longer one.
ENDS = frozenset('.,;:!?)]}"')
#: The least characters that LATER and CAPITALS have.
_FIRST_LATER, _FIRST_CAPITAL = LATER[0][0], CAPITALS[0][0]
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(f"[{WHITE}]+")
#: Chunks that a worker remembers; then it forgets them all.
REMEMBERED = 150_000
#: Bytes of text that are encoded together.
ENCODE_BLOCK = 1 << 22


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE file with word ends: ids, merges as sorted pair keys, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + end] for c in names], np.int32)
        left, right, made, maker = [], [], [], {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
            if made[-1] in maker or maker.get(left[-1], -1) > rank or maker.get(right[-1], -1) > rank:
                raise ValueError(f"merge {rank} is out of order: ranks can't be applied to all words at once")
            maker[made[-1]] = rank
        self.left, self.right, self.made = (np.array(x, np.int32) for x in (left, right, made))
        keys = self.key(self.left, self.right)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b.astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where the pair doesn't merge."""
        k = self.key(a, b)
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.rank_of[at], -1)


class PairIndex:
    """Pairs of a set of words by rank, each with all its positions."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]) -> None:
        self.v = vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        final = np.zeros(n, bool)
        final[self.ends - 1] = True
        self.symbol = np.where(final, self.v.last[data], self.v.inner[data]).astype(np.int32)
        self.next = np.where(final, -1, np.arange(1, n + 1))
        self.prev = np.arange(-1, n - 1)
        self.prev[self.ends[:-1]] = -1
        self.alive = np.ones(n, bool)
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.add(np.flatnonzero(~final))

    def add(self, at: np.ndarray) -> None:
        """Index the pairs that begin at the given positions."""
        if not len(at):
            return
        r = self.v.ranks(self.symbol[at], self.symbol[self.next[at]])
        at, r = at[r >= 0], r[r >= 0]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
        cut = np.flatnonzero(np.diff(r)) + 1
        firsts = [0, *cut.tolist()]
        for rank, part in zip(r[firsts].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
            if rank not in self.places:
                self.places[rank] = [part]
                heapq.heappush(self.heap, rank)
            else:
                self.places[rank].append(part)

    def run(self) -> None:
        """Apply the active ranks in ascending order."""
        symbol, nxt, prv, alive = self.symbol, self.next, self.prev, self.alive
        while self.heap:
            rank = heapq.heappop(self.heap)
            parts = self.places.pop(rank)
            a, b = self.v.left[rank], self.v.right[rank]
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[alive[at] & (symbol[at] == a) & (nxt[at] >= 0)]
            at = at[symbol[nxt[at]] == b]
            if a == b and len(at) > 1:
                joined = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            alive[gone] = False
            symbol[at] = self.v.made[rank]
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            self.add(np.unique(np.concatenate([before[before >= 0], at[after >= 0]])))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each word's."""
        kept = np.concatenate([[0], np.cumsum(self.alive)])
        return self.symbol[self.alive].astype(np.uint32), np.concatenate([[0], kept[self.ends]]) if len(self.ends) else np.zeros(1, np.int64)


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens, each of one byte at least."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    index = PairIndex(vocabulary, words)
    index.run()
    return index.ids()


def _reaches(text: str, least: int) -> bool:
    """Whether a text may have a character from least on: most have none, and for all but short ones this is quicker than a search for classes."""
    return not text.isascii() and (len(text) < 256 or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) >= least)


def normalised(text: str) -> str:
    """NFC, then lower case character by character (a final sigma isn't special)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        if _reaches(text, _FIRST_CAPITAL) and _CAPITAL.search(text):
            text = text.translate(_LOWER)
    return text.lower()


def chunks_of(text: str) -> list[str]:
    """The parts of a text between white space."""
    if _ODD_SPACE.search(text):
        return [x for x in _SPLIT.split(text) if x]
    return text.split()


def has_later(text: str) -> bool:
    """Whether a text has a character that Python's tables know and the library's don't."""
    return _reaches(text, _FIRST_LATER) and _LATER_SYMBOL.search(text) is not None


def plain_pieces(chunk: str, later: bool = True) -> tuple[str, str] | None:
    """The word of a chunk that is letters alone, or letters and one closing mark, and that mark or nothing; None for others.

    later: whether the chunk may have what has_later() looks for.
    """
    if later and has_later(chunk):
        return None
    if chunk.isalpha():
        return chunk, ""
    return (chunk[:-1], chunk[-1]) if chunk[-1] in ENDS and chunk[:-1].isalpha() else None


class Codes(dict):
    """Numbers chunks in the order in which they are first met."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def taken(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of flat (part i in bounds[i]:bounds[i+1]) that which names, end to end, and their bounds."""
    begin = bounds[which]
    lengths = bounds[which + 1] - begin
    total = np.concatenate([[0], np.cumsum(lengths)])
    return flat[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])], total


class ChunkEncoder:
    """Ids of texts through their chunks: what stands between white space is encoded once and remembered.

    encode_new turns new chunks into (ids, bounds).
    """

    def __init__(self, encode_new) -> None:
        self.encode_new, self.remembered = encode_new, REMEMBERED
        self.forget()

    def forget(self) -> None:
        self.codes = Codes()
        self.flat = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (each given as chunks), and the bounds of each text's."""
        if len(self.codes) > self.remembered:
            self.forget()
        known = len(self.codes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        which = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if len(self.codes) > known:
            flat, bounds = self.encode_new(list(islice(self.codes, known, None)))
            self.bounds = np.concatenate([self.bounds, bounds[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
        ids, total = taken(self.flat, self.bounds, which)
        return ids, total[np.concatenate([[0], np.cumsum(sizes)])]


class PairIndexEncoder(ChunkEncoder):
    """Chunks are normalised texts' parts; special tokens are cut out of texts before."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.special_pattern = vocabulary, vocabulary.special_pattern
        super().__init__(self._new)

    def _new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: dict[str, int] = {}
        which, sizes = [], []
        for c in chunks:
            if c[0] == " ":
                which.append(-1 - self.v.special[c[1:]])
                sizes.append(1)
                continue
            plain = plain_pieces(c)
            pieces = PIECES.findall(c) if plain is None else plain if plain[1] else plain[:1]
            sizes.append(len(pieces))
            which += [words.setdefault(p, len(words)) for p in pieces]
        ids, bounds = encode_words(self.v, [w.encode() for w in words])
        ids = np.concatenate([ids, np.array(sorted(self.v.special.values()), np.uint32)])
        at = np.array(which, np.int64)
        plain = at >= 0
        begin = np.empty(len(at), np.int64)
        length = np.ones(len(at), np.int64)
        begin[plain] = bounds[at[plain]]
        length[plain] = bounds[at[plain] + 1] - begin[plain]
        order = {i: k for k, i in enumerate(sorted(self.v.special.values()))}
        begin[~plain] = [int(bounds[-1]) + order[int(-1 - x)] for x in at[~plain]]
        total = np.concatenate([[0], np.cumsum(length)])
        out = ids[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        return out, total[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]

    def chunks(self, text: str) -> list[str]:
        """A special token is a chunk that begins with a space, as no other does."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return chunks_of(normalised(text))
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*self._plain(text[at : m.start()]), " " + m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        return chunks_of(normalised(text))


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids: the file has no decoder, so tokens are joined by one space."""
    return b" ".join(map(vocabulary.tokens.__getitem__, ids.tolist()))


_ENCODERS: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexEncoder(Vocabulary(path))
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(batches, text_col: str, block: int):
    for batch in batches:
        for part in C.blocks(batch, text_col, block):
            yield part, [t or "" for t in C.column(part, text_col).to_pylist()]


def encode(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = ENCODE_BLOCK) -> DataFrame:
    """(id_col, ids array<int>, decoded string) of each document."""
    C.ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for part, texts in _parts(batches, text_col, block):
            ids, bounds = e.encode([e.chunks(t) for t in texts])
            decoded = [decode(e.v, ids[a:b]).decode() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([C.column(part, id_col), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])
        e.forget()  # an idle worker keeps no memory

    return docs.select(id_col, text_col).mapInArrow(C.tidy(run), f"`{id_col}` {kind}, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = ENCODE_BLOCK) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode() and decode() with digests in place of their results."""
    C.ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for part, texts in _parts(batches, text_col, block):
            ids, bounds = e.encode([e.chunks(t) for t in texts])
            raw = memoryview(ids.astype("<u4").tobytes())
            ids_sha, text_sha = [], []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                ids_sha.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                text_sha.append(hashlib.sha256(decode(e.v, ids[a:b])).hexdigest())
            yield pa.RecordBatch.from_arrays([C.column(part, id_col), pa.array(np.diff(bounds)), pa.array(ids_sha), pa.array(text_sha)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()  # an idle worker keeps no memory

    return docs.select(id_col, text_col).mapInArrow(C.tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = ENCODE_BLOCK) -> DataFrame:
    """(id_col, ids array<int>, n_tokens, decoded_sha256) of each document: what training reads, and a digest of the way back."""
    C.ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        for part, texts in _parts(batches, text_col, block):
            ids, bounds = e.encode([e.chunks(t) for t in texts])
            sums = [hashlib.sha256(decode(e.v, ids[a:b])).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([C.column(part, id_col), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(np.diff(bounds)), pa.array(sums, pa.string())], [id_col, "ids", "n_tokens", "decoded_sha256"])
        e.forget()  # an idle worker keeps no memory

    return docs.select(id_col, text_col).mapInArrow(C.tidy(run), f"`{id_col}` {kind}, ids array<int>, n_tokens long, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of encode() and decode() over documents."""
    return encoded_digests(C.table(spark, sf_dir, "documents"))
