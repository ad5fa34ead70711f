"""MinHash near-duplicates by a multi-index Hamming join, with links confirmed on full sets.

A document's set is its distinct word shingles.  `n_symbols` independent minima, each cut
to `bits` bits, make its signature; the distance of two signatures is the number of symbols
in which they differ.  The signature is split into `n_chunks` chunks.  By pigeonhole two
signatures within `max_distance` have a chunk with at most max_distance // n_chunks errors,
so the join keys of a chunk are its symbols with every choice of that many left out: every
pair within max_distance shares a key.  With the defaults (64 symbols, 16 chunks, one error
in each) pairs beyond the distance that share a key are compared too, so a pair of
similarity 0.75 is missed with a probability of 5e-10 only.  `n_check` further minima of two
bits turn most other pairs away before sets are compared: beyond `max_check` of them a pair
of similarity 0.75 lies with a probability of 7e-10.

No bucket is expanded into pairs.  Sets that are equal are one vertex, and a task sends one
row for each key, however many of its documents have it.  Then

* the buckets of the first chunks are stars about their smallest documents; the stars' links
  are confirmed and become components, so a large family is mostly one component already;
* every bucket that still holds several components is compared once, in blocks: documents
  that have a partner of another component within the check distance send their texts to
  the block, and there links are confirmed on full sets.  A pair belongs to the first of the
  keys that it shares.  A block returns a spanning forest of its links.

Null, empty and word-less texts have empty sets and link with nothing.  A row whose id is
null is never linked: its component is null and it is kept.  Rows that repeat an id share a
component, whatever their texts.  Extra columns don't matter; an empty table gives no rows;
a text of any length is one set, held whole by a task that compares it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C
from panelweft.llm.components import components

#: Bits of the filter that keeps unneeded texts out of the shuffle: a size that doesn't grow.
FILTER_BITS = 1 << 23
#: Blocks over which the members of one star are spread.
STAR_SALT = 4096
#: Chunks whose buckets are stars first.
STAR_CHUNKS = 2
#: Documents whose keys a task puts together before it sends them.
FLUSH = 1 << 15
#: Members of a bucket that are compared in one block, and shingles whose sets a block holds at a time (but one set at least).
PAIR_BLOCK, SET_BLOCK = 4096, 1 << 19
#: Pairs whose signatures are compared at a time.
TILE = 1 << 16


class Scheme:
    """The signature's hash functions and the join keys of its chunks."""

    def __init__(self, n_symbols: int = 64, bits: int = 16, n_chunks: int = 16, max_distance: int = 31, n_check: int = 384, max_check: int = 121, seed: int = 7) -> None:
        if n_symbols % n_chunks or n_check % 64:
            raise ValueError("n_chunks must divide n_symbols, and 64 n_check")
        self.n_symbols, self.bits, self.n_chunks, self.max_distance = n_symbols, bits, n_chunks, max_distance
        self.n_check, self.max_check = n_check, max_check
        n = n_symbols + n_check
        raw = C.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(seed << 32))
        self.xor = (raw[:n] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.mul = ((raw[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.width = n_symbols // n_chunks
        self.errors = min(max_distance // n_chunks, self.width - 1)
        self.kept = list(combinations(range(self.width), self.width - self.errors))
        self.slots = n_chunks * len(self.kept)
        self.slot_bits = max(1, (self.slots - 1).bit_length())

    def signature(self, hashes: np.ndarray) -> bytes:
        """The symbols of a set of 64-bit hashes (repeats don't matter), then the two bit planes of its check symbols."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = None
        for at in range(0, len(x), 512):
            m = ((x[None, at : at + 512] ^ self.xor) * self.mul).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        low = low * np.uint32(0x9E3779B1)
        check = low[self.n_symbols :]
        planes = np.packbits(np.concatenate([check >> np.uint32(31), (check >> np.uint32(30)) & np.uint32(1)]).astype(bool))
        return (low[: self.n_symbols] >> np.uint32(32 - self.bits)).astype(np.uint16).tobytes() + planes.tobytes()

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and check planes of a column of signatures, a row each."""
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * self.n_symbols + self.n_check // 4)
        return np.ascontiguousarray(flat[:, : 2 * self.n_symbols]).view(np.uint16), np.ascontiguousarray(flat[:, 2 * self.n_symbols :]).view(np.uint64)

    def within(self, check: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which pairs of rows (r, c) are within the check distance."""
        x = check[r] ^ check[c]
        half = x.shape[1] // 2
        return np.bitwise_count(x[:, :half] | x[:, half:]).sum(axis=1) <= self.max_check

    def first_slot(self, symbols: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The first slot whose key pairs of rows (r, c) share (0 if none)."""
        same = (symbols[r] == symbols[c]).reshape(len(r), self.n_chunks, self.width)
        return np.stack([same[:, :, list(keep)].all(axis=2) for keep in self.kept], axis=2).reshape(len(r), self.slots).argmax(axis=1)

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        """(documents, slots) of uint64 from (documents, symbols): slot i in column i, and in a key's lowest bits."""
        s = symbols.reshape(len(symbols), self.n_chunks, self.width).astype(np.uint64)
        out = np.empty((len(symbols), self.n_chunks, len(self.kept)), np.uint64)
        for j, keep in enumerate(self.kept):
            slot = np.arange(self.n_chunks, dtype=np.uint64) * np.uint64(len(self.kept)) + np.uint64(j)
            k = C.mix(np.broadcast_to(slot + np.uint64(1), s.shape[:2]).copy())
            for i in keep:
                k = C.mix(k ^ (s[:, :, i] + np.uint64(1)))
            out[:, :, j] = (k << np.uint64(self.slot_bits)) | slot
        return out.reshape(len(symbols), self.slots)

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64((1 << self.slot_bits) - 1)).astype(np.int64)


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return C.column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def signatures(docs: DataFrame, scheme: Scheme, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, text_hash, n, set_a, set_b, sig): size and 128-bit hash of each document's shingle set, and its signature."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, "text"):
                g, bounds = C.doc_grams(C.words_of(*C.text_buffers(C.column(part, "text")), C.FOLDED), shingle)
                n, a, b, sig = [], [], [], []
                for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                    s = np.unique(g[lo:hi])
                    n.append(len(s))
                    if not len(s):
                        a.append(None), b.append(None), sig.append(None)
                        continue
                    a.append(int(C.mix(s).sum().astype(np.int64)))
                    b.append(int(C.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
                    sig.append(scheme.signature(s))
                yield C.batch_of(schema, C.column(part, "id"), C.column(part, "text_hash"), n, a, b, sig)

    return _texts(docs, id_col, text_col).mapInArrow(C.tidy(run), "id long, text_hash long, n long, set_a long, set_b long, sig binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def _grouped(keys: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> tuple:
    """All arrays in order of key and id; where each key's rows begin; how many they are."""
    order = np.lexsort((ids, keys))
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys, ids[order], *(x[order] for x in more)), at, np.diff(np.append(at, len(keys)))


def _star(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, size: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (smallest, other) pairs of the buckets of the first chunks."""
    least = np.repeat(ids[at], size)
    pick = (least != ids) & (scheme.slot_of(keys) < STAR_CHUNKS * len(scheme.kept))
    pairs = np.unique(np.stack([least[pick], ids[pick]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def buckets(reps: DataFrame, scheme: Scheme, n_parts: int) -> DataFrame:
    """(kind, x, y): kind 0 are the members (key, id) of the keys that several documents have, kind 1 the stars' links (a, b).

    A task sends one row for each of its keys, with the smallest of its documents; those that
    share a key within the task are members already.
    """
    schema = pa.schema([("part", pa.int32()), ("k", pa.binary()), ("v", pa.binary()), ("f", pa.binary())])
    made = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])

    def out(kind: int, x: np.ndarray, y: np.ndarray):
        return C.batch_of(made, np.full(len(x), kind, np.int32), x.view(np.int64), y)

    def local(batches):
        def sent(held):
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            k = scheme.keys(scheme.read(C.column(part, "sig"))[0])
            (keys, ids), at, size = _grouped(k.ravel(), np.repeat(_longs(part, "id"), k.shape[1]))
            several = np.repeat(size > 1, size)
            a, b = _star(keys, ids, at, size, scheme)
            rows = [(-1, keys[several].tobytes(), ids[several].tobytes(), b"")] if several.any() else []
            rows += [(-2, a.tobytes(), b.tobytes(), b"")] if len(a) else []
            keys, ids, flag = keys[at], ids[at], (size > 1).astype(np.uint8)
            to = ((keys >> np.uint64(scheme.slot_bits)) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(n_parts + 1)).tolist()
            keys, ids, flag = keys[order], ids[order], flag[order]
            rows += [(p, keys[lo:hi].tobytes(), ids[lo:hi].tobytes(), flag[lo:hi].tobytes()) for p, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)) if lo < hi]
            return C.batch_of(schema, *zip(*rows, strict=True))

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= FLUSH:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def merged(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for p, k, v, f in zip(*(C.column(batch, c).to_pylist() for c in ("part", "k", "v", "f")), strict=True):
                if p == -1:
                    yield out(0, np.frombuffer(k, np.int64), np.frombuffer(v, np.int64))
                elif p == -2:
                    yield out(1, np.frombuffer(k, np.int64), np.frombuffer(v, np.int64))
                else:
                    held.setdefault(p, []).append((np.frombuffer(k, np.uint64), np.frombuffer(v, np.int64), np.frombuffer(f, np.uint8)))
        for p in list(held):
            parts = held.pop(p)
            (keys, ids, flag), at, size = _grouped(*(np.concatenate([x[i] for x in parts]) for i in range(3)))
            # A task that has several documents of the key has sent them as members.
            pick = np.repeat((size > 1) | (flag[at] > 0), size) & (flag == 0)
            yield out(0, keys[pick], ids[pick])
            yield out(1, *_star(keys, ids, at, size, scheme))

    packed = reps.select("id", "sig").mapInArrow(C.tidy(local), "part int, k binary, v binary, f binary")
    spread = packed.repartitionById(n_parts, F.when(F.col("part") < 0, F.pmod(F.xxhash64("k"), F.lit(n_parts))).otherwise(F.col("part").cast("long")).cast("int"))
    return spread.mapInArrow(C.tidy(merged), "kind int, x long, y long")


def only(docs: DataFrame, id_col: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """docs without most rows whose id isn't in ids(id): a one-hash Bloom filter of fixed size, joined by broadcast.

    At most bits / 64 rows are broadcast whatever the input; rows that pass by chance do no harm.
    """
    bit = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    masks = ids.select(bit(F.col("id")).alias("x")).groupBy(F.shiftright("x", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("_mask"))
    marked = docs.withColumn("_x", bit(F.col(id_col)))
    return marked.join(F.broadcast(masks), F.shiftright("_x", 6) == F.col("_word")).filter(F.expr("shiftright(_mask, cast(_x & 63 as int)) & 1L = 1L")).drop("_x", "_word", "_mask")


def _whole(batches, columns: tuple[str, ...], size: int):
    """The rows in batches of whole blocks (runs of equal values of the columns), of about size bytes or one block at least."""

    def joined(held):
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held, total, tail = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [_longs(batch, c) for c in columns]
        turn = np.flatnonzero(np.any([np.diff(v) != 0 for v in values], axis=0)) + 1
        begins = tail is not None and tail != tuple(int(v[0]) for v in values)
        cut = int(turn[-1]) if len(turn) else 0 if begins else None
        tail = tuple(int(v[-1]) for v in values)
        if cut is not None and total + batch.nbytes >= size:
            yield joined([*held, batch.slice(0, cut)] if cut else held)
            held, total = [batch.slice(cut)], batch.nbytes * (batch.num_rows - cut) // batch.num_rows
        else:
            held.append(batch)
            total += batch.nbytes
    if held:
        yield joined(held)


class _Block:
    """Rows of whole blocks, in order of block, side and label, and their pairs that are worth a comparison of sets."""

    def __init__(self, batch: pa.RecordBatch, columns: tuple[str, ...], scheme: Scheme, percent: int, owned: bool) -> None:
        self.scheme, self.percent, self.owned = scheme, percent, owned
        values = [_longs(batch, c) for c in columns]
        self.key, self.side, self.id, self.label, self.n = values[0], _longs(batch, "side"), _longs(batch, "id"), _longs(batch, "label"), _longs(batch, "n")
        self.symbols, self.check = scheme.read(C.column(batch, "sig"))
        rows = len(self.key)
        new = np.concatenate([[True], np.any([v[1:] != v[:-1] for v in values], axis=0)])
        self.start = np.flatnonzero(new)
        self.block = np.cumsum(new) - 1
        end = np.append(self.start[1:], rows)[self.block]
        right = np.add.reduceat(self.side, self.start)
        # One side alone: pairs of its rows, from the end of the own label's run on; two sides: pairs across.
        turn = np.concatenate([new[1:] | (self.label[1:] != self.label[:-1]), [True]])
        after = np.flatnonzero(turn) + 1
        run_end = after[np.searchsorted(after, np.arange(rows), side="right")] if rows else after
        two = (right > 0)[self.block]
        self.lo = np.where(two, np.where(self.side == 0, end - right[self.block], end), run_end)
        self.hi = end

    def pairs(self):
        """(r, c): rows of different labels whose sizes and check symbols allow a link, once over all blocks if owned."""
        count = self.hi - self.lo
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(total, total[at] + TILE, side="right")) - 1)
            some = count[at:to]
            r = np.repeat(np.arange(at, to), some)
            c = np.arange(len(r)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(self.lo[at:to], some)
            at = to
            few, many = np.minimum(self.n[r], self.n[c]), np.maximum(self.n[r], self.n[c])
            ok = (100 * few >= self.percent * many) & (self.label[r] != self.label[c])
            r, c = r[ok], c[ok]
            ok = self.scheme.within(self.check, r, c)
            r, c = r[ok], c[ok]
            if self.owned and len(r):
                ok = self.scheme.first_slot(self.symbols, r, c) == self.scheme.slot_of(self.key[r].view(np.uint64))
                r, c = r[ok], c[ok]
            if len(r):
                yield r, c


_BLOCK = ("key", "ij", "uv")


def _involved(members: DataFrame, reps: DataFrame, scheme: Scheme, percent: int, n_parts: int) -> DataFrame:
    """(key, ij, uv, side, id, label): documents with a pair to confirm in a block; members(key, id, label) are those of mixed buckets."""
    counts = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("label", "n").alias("main")).filter("most < total")
    dealt = members.join(mixed, "key")
    # A small bucket is one block. In a large one, those of its main component aren't compared with each other.
    small, of = F.col("total") <= PAIR_BLOCK, lambda c: F.ceil(c / PAIR_BLOCK)
    dealt = dealt.withColumn("a", F.when(small, 0).otherwise(of(F.col("most")))).withColumn("b", F.when(small, 1).otherwise(of(F.col("total") - F.col("most"))))
    main, spread = (F.col("label") == F.col("main")) & ~small, F.xxhash64("id")
    dealt = dealt.withColumn("mine", F.when(main, F.pmod(spread, F.greatest("a", F.lit(1)))).otherwise(F.col("a") + F.pmod(spread, F.col("b"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(main, F.col("a")).otherwise(F.lit(0)).cast("long"), (F.col("a") + F.col("b") - 1).cast("long"))))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    dealt = dealt.select("key", (F.shiftleft(low.cast("long"), 32) + high).alias("ij"), ((low < high) & (F.col("mine") == high)).cast("int").alias("side"), "id", "label")
    rows = dealt.join(reps.select("id", "n", "sig"), "id").repartition(n_parts, "key", "ij").sortWithinPartitions("key", "ij", "side", "label", "id")
    schema = pa.schema([("key", pa.int64()), ("ij", pa.int64()), ("uv", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("label", pa.int64())])

    def run(batches):
        for batch in _whole(batches, ("key", "ij"), 1 << 21):
            x, ij = _Block(batch, ("key", "ij"), scheme, percent, True), _longs(batch, "ij")
            # Each side is cut where its sets become many.
            before = np.cumsum(x.n) - x.n
            turn = np.concatenate([[True], (x.block[1:] != x.block[:-1]) | (x.side[1:] != x.side[:-1])])
            cut = (before - before[np.flatnonzero(turn)][np.cumsum(turn) - 1]) // SET_BLOCK
            most, found = int(cut.max()) + 1, []
            for r, c in x.pairs():
                apart = ((cut[r] != cut[c]) | (x.side[r] != x.side[c])).astype(np.int64)
                uv = cut[r] * most + cut[c]
                found.append(np.unique(np.concatenate([(r * most * most + uv) * 2, (c * most * most + uv) * 2 + apart])))
            if found:
                code = np.unique(np.concatenate(found))
                row, uv = np.divmod(code // 2, most * most)
                yield C.batch_of(schema, x.key[row], ij[row], ((uv // most) << 32) + uv % most, (code % 2).astype(np.int32), x.id[row], x.label[row])

    return rows.select("key", "ij", "side", "id", "label", "n", "sig").mapInArrow(C.tidy(run), "key long, ij long, uv long, side int, id long, label long")


def confirmed(rows: DataFrame, texts: DataFrame, scheme: Scheme, shingle: int, percent: int, n_parts: int, owned: bool = True) -> DataFrame:
    """(a, b): labels of rows(key, ij, uv, side, id, label) joined by links of full sets; of each block a spanning forest.

    A block with side 1 is compared across its sides, one without within.
    """
    full = rows.join(texts, "id").repartition(n_parts, *_BLOCK).sortWithinPartitions(*_BLOCK, "side", "label", "id")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in _whole(batches, _BLOCK, C.BLOCK):
            x = _Block(batch, _BLOCK, scheme, percent, owned)
            pairs = list(x.pairs())
            if not pairs:
                continue
            left, right = (np.concatenate(p) for p in zip(*pairs, strict=True))
            g, bounds = C.doc_grams(C.words_of(*C.text_buffers(C.column(batch, "text")), C.FOLDED), shingle)
            sets: dict[int, np.ndarray] = {}
            parent: dict[tuple[int, int], tuple[int, int]] = {}
            a, b = [], []

            def root(v, parent=parent):
                while parent.setdefault(v, v) != v:
                    parent[v] = v = parent[parent[v]]
                return v

            def held(i, sets=sets, g=g, bounds=bounds):
                if i not in sets:
                    sets[i] = np.unique(g[bounds[i] : bounds[i + 1]])
                return sets[i]

            label, block = x.label.tolist(), x.block.tolist()
            begin = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(left)], strict=True):
                i = int(left[lo])
                here = root((block[i], label[i]))
                others = [j for j in right[lo:hi].tolist() if root((block[j], label[j])) != here]
                if not others:
                    continue
                s, theirs = held(i), [held(j) for j in others]
                all_ = np.concatenate(theirs)
                sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
                at = np.searchsorted(s, all_)
                both = np.add.reduceat(s[np.minimum(at, len(s) - 1)] == all_, np.cumsum(sizes) - sizes, dtype=np.int64)
                for j in np.flatnonzero(100 * both >= percent * (len(s) + sizes - both)).tolist():
                    p, q = root((block[i], label[i])), root((block[others[j]], label[others[j]]))
                    if p != q:
                        parent[p] = q
                        a.append(label[i]), b.append(label[others[j]])
            if a:
                yield C.batch_of(schema, np.minimum(a, b), np.maximum(a, b))

    return full.select(*_BLOCK, "side", "id", "label", "n", "sig", "text").mapInArrow(C.tidy(run), "a long, b long")


def _near(pairs: DataFrame, reps: DataFrame, scheme: Scheme, percent: int) -> DataFrame:
    """The pairs(a, b) whose sizes and check symbols allow a link."""
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").filter(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                both = np.concatenate([scheme.read(C.column(batch, c))[1] for c in ("sa", "sb")])
                ok = scheme.within(both, np.arange(n), np.arange(n, 2 * n))
                yield C.batch_of(schema, _longs(batch, "a")[ok], _longs(batch, "b")[ok])

    return met.select("a", "b", "sa", "sb").mapInArrow(C.tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, scheme: Scheme | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id): component by links of at least percent / 100 similarity."""
    spark = docs.sparkSession
    C.ship(spark)
    scheme = scheme or Scheme()
    path, n_parts = C.shared_dir(spark), C.width(spark)
    work = f"{path}/work"
    found = C.stored(signatures(docs, scheme, id_col=id_col, text_col=text_col, shingle=shingle), f"{work}/signatures")
    linkable = found.filter("n > 0 AND id IS NOT NULL")
    sets = C.stored(linkable.groupBy("set_a", "set_b").agg(F.min("id").alias("rep")), f"{work}/sets")
    # One row for each set, under its smallest id.
    reps = linkable.join(sets.select("set_a", "set_b", F.col("rep").alias("id")), ["set_a", "set_b", "id"]).dropDuplicates(["set_a", "set_b"])
    reps = C.stored(reps.select("id", "text_hash", "n", "sig"), f"{work}/reps")
    sigs = C.stored(found.drop("sig", "text_hash"), f"{path}/sizes")
    C.remove(spark, f"{work}/signatures")

    # An id with several texts ties their sets together.
    several = sigs.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).filter("low < high")
    ties = C.stored(several.select("id").join(sigs, "id").join(sets, ["set_a", "set_b"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct(), f"{work}/ties")

    met = C.stored(buckets(reps, scheme, n_parts), f"{work}/buckets")
    members = met.filter("kind = 0").select(F.col("x").alias("key"), F.col("y").alias("id"))
    ids = members.select("id").distinct()
    wanted = reps.join(ids, "id", "left_semi")
    wanted = C.stored(wanted, f"{work}/wanted")
    texts = only(_texts(docs, id_col, text_col), "id", wanted.select("id")).join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"])
    texts = C.stored(texts.select("id", "n", "sig", "text"), f"{work}/texts")

    stars = _near(met.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), wanted, scheme, percent)
    stars = C.stored(stars, f"{work}/stars").withColumn("ij", F.pmod(F.xxhash64("b"), F.lit(STAR_SALT)))
    side = lambda c, i: stars.select(F.col("a").alias("key"), "ij", F.lit(0).cast("long").alias("uv"), F.lit(i).alias("side"), F.col(c).alias("id"), F.col(c).alias("label"))
    ends = side("a", 0).distinct().unionByName(side("b", 1))
    links = C.stored(confirmed(ends, texts, scheme, shingle, percent, n_parts, owned=False).unionByName(ties), f"{work}/links0")
    labels = components(links, f"{work}/cc0")
    placed = C.stored(wanted.select("id").unionByName(ties.select(F.col("a").alias("id"))).unionByName(ties.select(F.col("b").alias("id"))).distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label")), f"{work}/placed0")

    active = C.stored(members.join(placed, "id"), f"{work}/members")
    blocks = C.stored(_involved(active, wanted, scheme, percent, n_parts), f"{work}/blocks")
    links = C.stored(confirmed(blocks, texts, scheme, shingle, percent, n_parts).distinct(), f"{work}/links1")
    up = components(links, f"{work}/cc1")  # of components: few vertices, whatever their sizes
    placed = placed.join(up.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    by_set = C.stored(sets.join(placed.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("component")), f"{path}/by_set")
    C.remove(spark, work)
    out = sigs.select("id", "n", "set_a", "set_b").join(by_set, ["set_a", "set_b"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, with all its columns, with one document of each component: the one of least id, once. Rows without an id stay.

    Of rows that repeat that id, one with the least hash of its text stays.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"), F.struct("*").alias("row"))  # whatever docs' columns are called
    found = near_duplicates(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), id_col="id", text_col="text", **options)
    gone = found.filter("id <> component_id").select(F.col("id").alias("gone")).distinct()
    left = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    if rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty():
        return left.select("row.*")
    known = left.filter("id IS NOT NULL")
    least = known.groupBy(F.col("id").alias("of")).agg(F.min("hash").alias("least"))
    one = known.join(least, (F.col("id") == F.col("of")) & (F.col("hash") == F.col("least"))).select("id", "row").dropDuplicates(["id"])
    return left.filter("id IS NULL").select("row.*").unionByName(one.select("row.*"))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from near_duplicates() over documents."""
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
