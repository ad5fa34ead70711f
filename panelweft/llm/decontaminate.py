"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every run of `window` consecutive words of a benchmark item (a shorter item is one window)
is a set of word shingles.  The shingles of a window are ordered by rarity, by their counts
over all documents, and as a window must be contained whole, one prefix shingle, its rarest,
is necessary: a document without it cannot hold the window.  Documents are joined on prefix
shingles alone.  The shingle's place in the window bounds where the window would start
(positional bound) and the document's word count bounds where it could end (length bound);
what passes is verified word by word over the item-sized window.

The benchmark goes to every task while its windows number at most `max_broadcast_windows`;
beyond that the same join runs on shuffled prefix shingles (see `_join_shuffled`), so
nothing unbounded is broadcast.

Null or empty texts have no words and no hits; repeated rows are judged one by one; extra
columns pass through; an empty benchmark leaves every document clean.  An item whose id is
null hits words as any other, but isn't counted or named among a document's items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C

#: Most item windows that are sent to every task: about 200 bytes each, so some 40 MB.
MAX_BROADCAST_WINDOWS = 200_000


class Windows:
    """Distinct item windows: word hashes end to end, and the shingles that may be prefixes."""

    def __init__(self, items: list[tuple], window: int, shingle: int) -> None:
        data, offsets = C.text_buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        w = C.words_of(data, offsets, C.ALNUM)
        found: dict[bytes, tuple[np.ndarray, set]] = {}
        for i, (item, _) in enumerate(items):
            seq = w.hash[w.bounds[i] : w.bounds[i + 1]]
            size = min(window, len(seq))
            for at in range(len(seq) - size + 1 if size else 0):
                part = seq[at : at + size]
                found.setdefault(part.tobytes(), (part, set()))[1].update([item] if item is not None else [])
        self.seqs = [s for s, _ in found.values()]
        self.items = [sorted(x) for _, x in found.values()]
        self.lengths = np.array([len(s) for s in self.seqs], np.int64)
        self.shingle = shingle
        self.sets = [C.grams(s, min(shingle, len(s))) for s in self.seqs]

    def by_width(self) -> dict[int, np.ndarray]:
        """Sorted shingle hashes by shingle width (short windows have narrower shingles)."""
        out: dict[int, list] = {}
        for s, g in zip(self.seqs, self.sets, strict=True):
            out.setdefault(min(self.shingle, len(s)), []).append(g)
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def _lookup(sorted_keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in h whose value is among sorted_keys, and which key each is.

    A table of 16 hash bits turns almost all values away before the binary search.
    """
    seen = np.zeros(1 << 16, bool)
    seen[sorted_keys >> np.uint64(48)] = True
    at = np.flatnonzero(seen[h >> np.uint64(48)])
    k = np.searchsorted(sorted_keys, h[at])
    k[k == len(sorted_keys)] = 0
    same = sorted_keys[k] == h[at]
    return at[same], k[same]


def shingle_counts(docs: DataFrame, keys: dict[int, np.ndarray], text_col: str = "text") -> DataFrame:
    """(width, shingle, n): occurrences over all documents of the given shingles; a task sends one row for each at most."""
    schema = pa.schema([("width", pa.int32()), ("shingle", pa.int64()), ("n", pa.int64())])

    def count(batches):
        sums = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in batches:
            for part in C.blocks(batch, text_col):
                w = C.words_of(*C.text_buffers(C.column(part, text_col)), C.ALNUM)
                for k, v in keys.items():
                    at, which = _lookup(v, C.grams(w.hash, k))
                    sums[k] += np.bincount(which, minlength=len(v))  # across document ends too: rarity need not be exact
        for k, v in keys.items():
            some = np.flatnonzero(sums[k])
            yield C.batch_of(schema, np.full(len(some), k, np.int32), v[some].view(np.int64), sums[k][some])

    return docs.select(text_col).mapInArrow(C.tidy(count), "width int, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))


def _prefixes(win: Windows, counts: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By shingle width: sorted prefix shingles, one for each window, its window and its place there."""
    rows: dict[int, list] = {}
    for i, g in enumerate(win.sets):
        k = min(win.shingle, len(win.seqs[i]))
        rarity = [(counts.get((k, int(x)), 0), int(x)) for x in g.view(np.int64)]
        place = min(range(len(g)), key=lambda j: (rarity[j], j))
        rows.setdefault(k, []).append((g[place], i, place))
    out = {}
    for k, r in rows.items():
        h = np.array([x[0] for x in r], np.uint64)
        order = np.argsort(h, kind="stable")
        out[k] = (h[order], np.array([x[1] for x in r])[order], np.array([x[2] for x in r])[order])
    return out


def _verified(w: C.Words, at: np.ndarray, which: np.ndarray, place: np.ndarray, lengths: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of the candidates that pass the positional and length bounds and match word by word."""
    doc = np.searchsorted(w.bounds, at, side="right") - 1
    start = at - place[which]
    ok = (start >= w.bounds[doc]) & (start + lengths[which] <= w.bounds[doc + 1])
    start, which = start[ok], which[ok]
    for j in range(int(lengths.max(initial=0))):
        if not len(start):
            break
        need = lengths[which] > j
        same = ~need
        same[need] = w.hash[start[need] + j] == flat[begins[which[need]] + j]
        start, which = start[same], which[same]
    return start, which


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items (sorted, comma-joined), contaminated, and hits (byte-free word intervals)."""
    C.ship(docs.sparkSession)
    if not _bounded(benchmark, item_text_col, max_broadcast_windows):
        return _join_shuffled(docs, benchmark, id_col, text_col, item_col, item_text_col, window, shingle).drop("_row")
    shared = _prepared(docs, benchmark, text_col, item_col, item_text_col, window, shingle)
    kind = docs.schema[id_col].dataType.simpleString()

    def match(batches):
        for batch in batches:
            for part in C.blocks(batch, text_col):
                yield _match_block(part, id_col, text_col, *shared.value)

    return docs.select(id_col, text_col).mapInArrow(C.tidy(match), f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items string, contaminated boolean, hits array<struct<start:long,end:long>>")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """docs, with all its columns, without the rows that hold a window of the benchmark."""
    C.ship(docs.sparkSession)
    if not _bounded(benchmark, item_text_col, max_broadcast_windows):
        found = _join_shuffled(docs, benchmark, id_col, text_col, item_col, item_text_col, window, shingle).filter("contaminated").select("_row").distinct()
        rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_row"), F.struct("*").alias("held"))  # whatever docs' columns are called
        return rows.join(found, "_row", "left_anti").select("held.*")
    shared = _prepared(docs, benchmark, text_col, item_col, item_text_col, window, shingle)

    def keep(batches):
        for batch in batches:
            for part in C.blocks(batch, text_col):
                hit = C.column(_match_block(part, id_col, text_col, *shared.value), "contaminated")
                yield part.filter(pc.invert(hit))

    return docs.mapInArrow(C.tidy(keep), docs.schema)


def _bounded(benchmark: DataFrame, item_text_col: str, most: int) -> bool:
    """Whether the windows are few enough to be sent to every task: a word and its separator are two characters at least."""
    return (benchmark.agg(F.sum(F.floor(F.length(item_text_col) / 2) + 1)).first()[0] or 0) <= most


def _prepared(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, shingle: int):
    """A broadcast of the prefixes and the windows of a bounded benchmark."""
    win = Windows([(r[0], r[1]) for r in benchmark.select(F.col(item_col).cast("string"), item_text_col).collect()], window, shingle)
    keys = win.by_width()
    counts = {(r["width"], r["shingle"]): r["n"] for r in shingle_counts(docs, keys, text_col).collect()} if keys else {}
    flat = np.concatenate(win.seqs) if win.seqs else np.zeros(0, np.uint64)
    begins = np.concatenate([[0], np.cumsum(win.lengths)])
    return docs.sparkSession.sparkContext.broadcast((_prefixes(win, counts), win.lengths, flat, begins, win.items))


def _match_block(part, id_col, text_col, prefixes, lengths, flat, begins, names) -> pa.RecordBatch:
    w = C.words_of(*C.text_buffers(C.column(part, text_col)), C.ALNUM)
    starts, whiches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (keys, window, place) in prefixes.items():
        h = C.grams(w.hash, k)
        at, first = _lookup(keys, h)
        if not len(at):
            continue
        # A prefix shingle may stand for several windows: walk through its equal keys.
        last = np.searchsorted(keys, h[at], side="right")
        first = np.searchsorted(keys, h[at], side="left")
        reps = last - first
        row = np.repeat(first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        places = np.zeros(len(lengths), np.int64)
        places[window] = place
        s, x = _verified(w, np.repeat(at, reps), window[row], places, lengths, flat, begins)
        starts.append(s)
        whiches.append(x)
    start, which = np.concatenate(starts), np.concatenate(whiches)
    n = part.num_rows
    hit = C.covered(len(w.hash), start, lengths[which]) if len(start) else np.zeros(len(w.hash), bool)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[w.bounds[1:]] - total[w.bounds[:-1]]
    items, n_items, hits = [""] * n, np.zeros(n, np.int64), [[] for _ in range(n)]
    doc = np.searchsorted(w.bounds, start, side="right") - 1
    for d in np.unique(doc):
        ids = sorted({x for k in set(which[doc == d].tolist()) for x in names[k]})
        items[d], n_items[d] = ",".join(ids), len(ids)
        a, b = C.runs(hit[w.bounds[d] : w.bounds[d + 1]])
        hits[d] = [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)]
    return pa.RecordBatch.from_arrays([C.column(part, id_col), pa.array(w.counts), pa.array(n_hit), pa.array(n_items), pa.array(items, pa.string()), pa.array(n_hit > 0), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [id_col, "n_words", "n_hit", "n_items", "items", "contaminated", "hits"])


def _join_shuffled(docs, benchmark, id_col, text_col, item_col, item_text_col, window, shingle) -> DataFrame:
    """The same join where the benchmark is large: prefix shingles are shuffle keys.

    Windows and documents become rows of (shingle, ...), rarity comes from a join with the
    counts of all documents' shingles, only each window's rarest shingle stays, and the
    candidates that pass both bounds travel to their document to be verified there.  _row, the
    hash of id and text, tells rows apart whose ids are null or repeated.
    """
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda c: F.regexp_extract_all(lower(F.coalesce(c, F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    item = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("iw")).filter(F.size("iw") > 0)
    size = F.least(F.lit(window), F.size("iw"))
    win = item.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("iw") - size + 1), lambda i: F.slice("iw", i, size))).alias("win")).groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    width = F.least(F.lit(shingle), F.size("win"))
    places = win.select("win", "items", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("win") - width + 1), lambda i: F.array_join(F.slice("win", i, width), " "))).alias("place", "token"))
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("dw"))
    widths = F.array(*[F.lit(i) for i in range(1, shingle + 1)])
    tokens = rows.select("row", "id", F.size("dw").alias("n"), "dw", F.explode(widths).alias("k")).filter("n >= k").select("row", "id", "n", F.posexplode(F.expr("transform(sequence(1, n - k + 1), i -> array_join(slice(dw, i, k), ' '))")).alias("pos", "token"))
    tokens = tokens.join(places.select("token").distinct(), "token", "left_semi")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n_rows"))
    rarest = places.join(counts, "token", "left").groupBy("win", "items").agg(F.min_by(F.struct("token", "place"), F.struct(F.coalesce("n_rows", F.lit(0)), "token", "place")).alias("p")).select("win", "items", "p.token", "p.place")
    cand = tokens.join(rarest, "token").select("row", "id", (F.col("pos") - F.col("place")).alias("start"), "n", "win", "items").filter((F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.col("n"))).distinct()
    true = cand.select("row", "id", "start", "win", "items").join(rows.dropDuplicates(["row"]), ["row"]).filter(F.slice("dw", F.col("start") + 1, F.size("win")) == F.col("win"))
    per = true.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.size("win") - 1))))).alias("hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    begins, ends = F.expr("filter(hit, (p, i) -> get(hit, i - 1) IS DISTINCT FROM p - 1)"), F.expr("filter(hit, (p, i) -> get(hit, i + 1) IS DISTINCT FROM p + 1)")
    per = per.select("row", "ids", F.size("hit").cast("long").alias("n_hit"), begins.alias("a"), ends.alias("b")).withColumn("hits", F.expr("transform(a, (p, i) -> named_struct('start', cast(p AS bigint), 'end', cast(get(b, i) + 1 AS bigint)))"))
    out = rows.select("row", "id", F.size("dw").cast("long").alias("n_words")).join(per, "row", "left")
    return out.select(F.col("row").alias("_row"), F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("hits", F.array().cast("array<struct<start:long,end:long>>")).alias("hits"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of decontaminate() over documents and benchmark."""
    out = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hit AS (SELECT d.doc_id, d.i, d.k, win.item_id FROM dwin d JOIN win ON d.k = win.k AND d.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
