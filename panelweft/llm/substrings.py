"""Substring deduplication with an FM-index per shard.

A window is `window` consecutive words of a document; a word is removed if it lies in a
window whose words also begin earlier (in a smaller identifier, or before in the document).

Windows are dealt to shards by content: of each window the least-hashed run of window // 2
words is its anchor, so equal windows have equal anchors, and consecutive windows with one
anchor travel as one segment.  Four passes:

1. Equal texts become one content, with the least identifier; its other copies are repeats
   through and through, as far as they have a window.
2. Anchors that occur once are dropped.  Each task combines its own repeats first, so an
   anchor sends a shard one entry a block, however often it occurs.
3. The segments of repeated anchors, equal ones combined to the earliest, are dealt to
   shards.  Anchors with very many different segments are cut into single windows, which
   combine again where they are equal and spread over the shards where they aren't.
   A shard builds an FM-index (wavelet matrix over the Burrows-Wheeler transform) of its
   segments, in pieces of bounded size that hold all of an anchor's segments, streams the
   segments through it, and by their matching statistics reports for each segment the
   windows whose suffix interval has nothing earlier.
4. Each content is cut: windows of repeated anchors are repeats except those reported first.

Words are compared by 64-bit hashes; segments are grouped by their words themselves.

Null texts have no words.  A null identifier counts as less than all others.  Rows that
repeat identifier and text have one result; rows that share an identifier but not a text
are ordered by a hash of their texts.  Extra columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C
from panelweft.llm.fmindex import FMIndex

#: Different segments beyond which an anchor is cut into single windows.
HOT_SEGMENTS = 2_000
#: Tokens that one index of a shard holds, unless a single anchor has more.
INDEX_TOKENS = 400_000
LEAST = -(1 << 63)


def _segments(w: C.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's documents: anchor hash, document, first window and number of windows of each segment."""
    m = window // 2
    g = C.grams(w.hash, m)
    span = window - m + 1
    none = np.zeros(0, np.int64)
    if len(g) < span:
        return none.astype(np.uint64), none, none, none
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    anchor = np.arange(len(view)) + view.argmin(axis=1)
    doc = w.doc()
    at = np.flatnonzero(doc[: len(view)] == doc[window - 1 :][: len(view)])
    if not len(at):
        return none.astype(np.uint64), none, none, none
    new = np.concatenate([[True], (np.diff(anchor[at]) != 0) | (np.diff(doc[at]) != 0)])
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    return g[anchor[first]], doc[first], first - w.bounds[doc[first]], count


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    return C.text_buffers(pa.array([z.decompress(x) if x else b"" for x in C.column(part, "text").to_pylist()], pa.large_binary()))


def contents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, row2, id, text): distinct texts, compressed, with their least identifier."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("row2"), "text")
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("row2", pa.int64()), ("text", pa.binary())])

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in C.blocks(batch, "text"):
                data, offsets = C.text_buffers(C.column(part, "text"))
                raw = memoryview(data)
                yield pa.RecordBatch.from_arrays([*(C.column(part, c) for c in ("id", "row", "row2")), pa.array([z.compress(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.binary())], schema=schema)

    return rows.mapInArrow(C.tidy(run), "id long, row long, row2 long, text binary").groupBy("row", "row2").agg(F.min("id").alias("id"), F.first("text").alias("text"))


def repeated(texts: DataFrame, window: int, n_parts: int) -> DataFrame:
    """(row, row2, starts): first windows of the segments whose anchor occurs more than once."""

    def local(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in C.blocks(batch, "text", 1 << 20):
                key, doc, start, _ = _segments(C.words_of(*_texts(part), C.PLAIN), window)
                row, row2 = (C.column(part, c).to_numpy() for c in ("row", "row2"))
                order = np.argsort(key, kind="stable")
                k = key[order]
                new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
                size = np.diff(np.append(np.flatnonzero(new), len(k)))
                many = np.repeat(size > 1, size)
                own = order[many]
                parts, blobs = [-1], [z.compress(np.stack([row[doc[own]], row2[doc[own]], start[own]]).astype(np.int64).tobytes())]
                # One entry for an anchor: its only place, or -1 for several.
                one = order[new]
                place = np.where(size > 1, -1, doc[one])
                target = (key[one] % np.uint64(n_parts)).astype(np.int64)
                by = np.lexsort((one, target))
                one, place, target = one[by], place[by], target[by]
                cut = np.searchsorted(target, np.arange(n_parts + 1))
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    e = slice(cut[p], cut[p + 1])
                    used, at = np.unique(place[e], return_inverse=True)
                    docs = np.stack([np.where(used < 0, 0, row[used]), np.where(used < 0, 0, row2[used])]).astype(np.int64)
                    head = np.array([len(at), len(used), used[0] < 0], np.int64)
                    parts.append(p)
                    blobs.append(z.compress(head.tobytes() + key[one[e]].tobytes() + docs.tobytes() + at.astype(np.int32).tobytes() + start[one[e]].astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    schema = pa.schema([("row", pa.int64()), ("row2", pa.int64()), ("start", pa.int32())])

    def merged(batches):
        z = zstandard.ZstdDecompressor()
        held: dict[int, list] = {}
        for batch in batches:
            for p, blob in zip(C.column(batch, "part").to_pylist(), C.column(batch, "blob").to_pylist(), strict=True):
                raw = z.decompress(blob)
                if p < 0:
                    r, r2, s = np.frombuffer(raw, np.int64).reshape(3, -1)
                    yield C.batch_of(schema, r, r2, s.astype(np.int32))
                    continue
                n, d, several = np.frombuffer(raw, np.int64, 3).tolist()
                key = np.frombuffer(raw, np.uint64, n, 24)
                docs = np.frombuffer(raw, np.int64, 2 * d, 24 + 8 * n).reshape(2, d)
                at = np.frombuffer(raw, np.int32, n, 24 + 8 * n + 16 * d)
                start = np.frombuffer(raw, np.int32, n, 24 + 12 * n + 16 * d)
                held.setdefault(p, []).append((key, docs[0][at], docs[1][at], start, (at == 0) & bool(several)))
        for p in list(held):
            key, row, row2, start, several = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            _, back, size = np.unique(key, return_inverse=True, return_counts=True)
            hit = np.flatnonzero((size[back] > 1) & ~several)
            # An anchor that is repeated in one block only has no other entry, and needs none.
            lone = np.zeros(len(size), bool)
            lone[back[several]] = True
            hit = np.union1d(hit, np.flatnonzero(lone[back] & ~several))
            yield C.batch_of(schema, row[hit], row2[hit], start[hit])

    packed = texts.select("row", "row2", "text").mapInArrow(C.tidy(local), "part int, blob binary")
    spread = packed.repartition(n_parts, F.when(F.col("part") < 0, F.xxhash64("blob")).otherwise(F.col("part").cast("long")))
    return spread.mapInArrow(C.tidy(merged), "row long, row2 long, start int").groupBy("row", "row2").agg(F.collect_list("start").alias("starts"))


def segments(marked: DataFrame, window: int) -> DataFrame:
    """(key, words, id, start, row, row2) of the marked segments of marked(row, row2, id, text, starts)."""
    schema = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("id", pa.int64()), ("start", pa.int32()), ("row", pa.int64()), ("row2", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, "text", 1 << 20):
                data, offsets = _texts(part)
                w = C.words_of(data, offsets, C.PLAIN)
                key, doc, start, count = _segments(w, window)
                starts = C.column(part, "starts")
                wanted = np.concatenate([np.zeros(0, np.int64), *(i * (1 << 32) + np.asarray(s.as_py(), np.int64) for i, s in enumerate(starts))])
                take = np.flatnonzero(np.isin(doc * (1 << 32) + start, wanted))
                a = w.bounds[doc[take]] + start[take]
                raw = data.tobytes()
                words = [b" ".join(raw[x:y].split()) for x, y in zip(w.start[a].tolist(), w.end[a + count[take] + window - 2].tolist(), strict=True)]
                own = [C.column(part, c).to_numpy()[doc[take]] for c in ("id", "row", "row2")]
                yield C.batch_of(schema, key[take].view(np.int64), words, own[0], start[take].astype(np.int32), own[1], own[2])

    return marked.mapInArrow(C.tidy(run), "key long, words binary, id long, start int, row long, row2 long")


def _split_hot(hot: DataFrame, window: int) -> DataFrame:
    """Single windows of segments, keyed by their own words."""
    schema = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("id", pa.int64()), ("start", pa.int32()), ("row", pa.int64()), ("row2", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, "words", 1 << 20):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for words, i, start, row, row2 in zip(*(C.column(part, c).to_pylist() for c in ("words", "id", "start", "row", "row2")), strict=True):
                    parts = words.split(b" ")
                    for at in range(len(parts) - window + 1):
                        one = b" ".join(parts[at : at + window])
                        h = int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True)
                        for c, v in zip(out, (h, one, i, start + at, row, row2), strict=True):
                            c.append(v)
                yield C.batch_of(schema, *out)

    return hot.mapInArrow(C.tidy(run), "key long, words binary, id long, start int, row long, row2 long")


def _earliest(rows: DataFrame) -> DataFrame:
    """Equal segments combined to the first in order."""
    return rows.groupBy("key", "words").agg(F.min(F.struct("id", "row", "row2", "start")).alias("o")).select("key", "words", "o.*")


def first_windows(rows: DataFrame, window: int, n_parts: int) -> DataFrame:
    """(row, row2, at): word places of the windows of the distinct segments that begin nowhere earlier."""
    schema = pa.schema([("row", pa.int64()), ("row2", pa.int64()), ("at", pa.int32())])

    def judged(held: list[tuple]):
        held.sort(key=lambda r: r[1:])
        texts = [r[0] for r in held]
        data, offsets = C.text_buffers(pa.array(texts, pa.large_binary()))
        w = C.words_of(data, offsets, C.PLAIN)
        index = FMIndex(w.hash, w.bounds[1:], 2 * window)
        counts = w.counts - window + 1
        seg = np.repeat(np.arange(len(held)), counts)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = index.place[w.bounds[seg] + inside]
        # Streamed through the index, a window is an interval above the threshold; it is a repeat if its suffixes begin earlier too.
        reach, lo, hi = index.matches(w.hash, w.bounds[seg] + inside + window, window)
        fresh = (reach < window) | (index.earliest(lo, hi) == begin)
        seg, inside = seg[fresh], inside[fresh]
        start, row, row2 = (np.array([r[k] for r in held], np.int64) for k in (4, 2, 3))
        yield C.batch_of(schema, row[seg], row2[seg], (start[seg] + inside).astype(np.int32))

    def run(batches):
        held, key, tokens = [], None, 0
        for batch in batches:
            for k, words, i, row, row2, start in zip(*(C.column(batch, c).to_pylist() for c in ("key", "words", "id", "row", "row2", "start")), strict=True):
                if k != key and tokens >= INDEX_TOKENS:
                    yield from judged(held)
                    held, tokens = [], 0
                key = k
                held.append((words, i, row, row2, start))
                tokens += 1 + words.count(b" ")
        if held:
            yield from judged(held)

    dealt = rows.repartition(n_parts, "key").sortWithinPartitions("key")
    return dealt.select("key", "words", "id", "row", "row2", "start").mapInArrow(C.tidy(run), "row long, row2 long, at int")


def cut(marked: DataFrame, window: int) -> DataFrame:
    """(row, row2, id, n_words, n_removed, kept_sha256, removed) of marked(row, row2, id, text, starts, firsts)."""
    schema = pa.schema([("row", pa.int64()), ("row2", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, "text", 1 << 20):
                data, offsets = _texts(part)
                w = C.words_of(data, offsets, C.PLAIN)
                raw = data.tobytes()
                _, doc, start, count = _segments(w, window)
                n, removed, sha, spans = w.counts, [], [], []
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for i, (starts, firsts) in enumerate(zip(C.column(part, "starts").to_pylist(), C.column(part, "firsts").to_pylist(), strict=True)):
                    words = raw[offsets[i] : offsets[i + 1]].split()
                    gone = np.zeros(int(n[i]), bool)
                    if starts:
                        e = slice(edge[i], edge[i + 1])
                        take = np.isin(start[e], starts)
                        s, c = start[e][take], count[e][take]
                        dup = C.covered(int(n[i]), s, c)
                        dup[np.asarray(firsts or [], np.int64)] = False
                        at = np.flatnonzero(dup)
                        gone = C.covered(int(n[i]), at, np.full(len(at), window))
                        words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    a, b = C.runs(gone)
                    spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
                yield C.batch_of(schema, C.column(part, "row"), C.column(part, "row2"), C.column(part, "id"), n, removed, sha, pa.array(spans, schema.field("removed").type))

    return marked.mapInArrow(C.tidy(run), "row long, row2 long, id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,stop:long>>")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, removed): removed has the word intervals to cut."""
    spark = docs.sparkSession
    C.ship(spark)
    path, n = C.shared_dir(spark), C.width(spark)
    work = f"{path}/work"
    texts = C.stored(contents(docs, id_col, text_col), f"{work}/contents")
    marks = C.stored(repeated(texts, window, n), f"{work}/marks")
    found = C.stored(_earliest(segments(texts.join(marks, ["row", "row2"]), window)), f"{work}/segments")
    hot = found.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_segments).select("key")
    split = _earliest(_split_hot(found.join(hot, "key", "left_semi"), window))
    every = found.join(hot, "key", "left_anti").unionByName(split)
    firsts = C.stored(first_windows(every, window, n).groupBy("row", "row2").agg(F.collect_list("at").alias("firsts")), f"{work}/firsts")
    C.remove(spark, f"{work}/segments")
    both = marks.join(firsts, ["row", "row2"], "left")
    done = C.stored(cut(texts.join(both, ["row", "row2"], "left"), window), f"{path}/done")
    C.remove(spark, work)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row"), F.xxhash64(F.lit(1), F.coalesce(text_col, F.lit(""))).alias("row2"))
    out = rows.join(done, ["row", "row2"])
    copy = (F.col("_id") != F.col("id")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    return out.select(id_col, "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"), F.when(copy, whole).otherwise(F.col("removed")).alias("removed"))


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from deduplicate() over documents."""
    return deduplicate(C.table(spark, sf_dir, "documents")).drop("removed")
