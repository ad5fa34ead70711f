"""Importance resampling towards a target distribution of hashed word n-grams.

Every run of 1 to `length` words is a feature of a bucket.  A bucket's gain is the log ratio of
its smoothed shares in the target and in all documents, in thousandths; a document's weight is
the mean gain of its features, looked up in an array of one number a bucket, and its score is
that weight plus Gumbel noise that a digest of its id decides.  The greatest scores of the
eligible documents (min_words words at least) are drawn without replacement.

The draw is a distributed external merge.  Tasks sort bounded chunks of their eligible rows
into runs and cut these at range bounds, which a histogram of the scores gives: scores are
whole thousandths, some hundred thousand different ones at most whatever the input, and a score
that alone is more than a range is cut by ids.  Each range is merged by a task of its own, in a
k-way tournament tree that opens a block of a run only when its first key is due; its rows are
ranked from the number of rows in the ranges before.  The range in which the draw is complete
stops there, and ranges after it are never merged.  A range has RANGE_ROWS rows at most, or the
repeats of one row, which travel as one row and a number.

Null and empty texts have no features, weight 0, and are not eligible unless min_words is 0.
A null id hashes like an empty one and comes before all others.  Rows that repeat an id are
rows of their own; ties go to the smaller id and then to fewer features, after which rows are
equal.  Extra columns don't matter; empty tables give no rows; texts are taken whole.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C
from panelweft.llm import ordered

BUCKETS = 10_000
#: Rows that a task sorts into one run.
RUN_ROWS = 1 << 18
#: Rows of a run that are read at once when it is merged.
BLOCK_ROWS = 1 << 12
#: Rows that one range has, unless they are the repeats of one row.
RANGE_ROWS = 1 << 20
#: Bytes of a word after which its CRC is left to zlib.
LONG_WORD = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def _crc_on(register: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 registers (not yet inverted) after size bytes of data from start each."""
    out = register.copy()
    live = np.flatnonzero(size > 0)
    for j in range(min(LONG_WORD, int(size.max(initial=0)))):
        at = out[live]
        out[live] = _CRC[(at ^ data[start[live] + j]) & np.uint32(255)] ^ at >> np.uint32(8)
        live = live[size[live] > j + 1]
    for i in live if int(size.max(initial=0)) > LONG_WORD else ():
        a = int(start[i])
        out[i] = zlib.crc32(data[a + LONG_WORD : a + int(size[i])].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, offsets: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every feature, and each document's number of words."""
    w = C.words_of(data, offsets, C.ALNUM)
    folded, size, doc = _FOLD[data], w.end - w.start, w.doc()
    register = np.full(len(size), 0xFFFFFFFF, np.uint32)
    found, owner = [], []
    for k in range(length):
        n = max(len(size) - k, 0)
        if k:  # one word more, after a space
            at = register[:n]
            at = _CRC[(at ^ np.uint32(32)) & np.uint32(255)] ^ at >> np.uint32(8)
        else:
            at = register
        register = _crc_on(at, folded, w.start[k:], size[k:])
        inside = doc[:n] == doc[k:]
        found.append(((register ^ np.uint32(0xFFFFFFFF))[inside] % np.uint32(buckets)).astype(np.int64))
        owner.append(doc[:n][inside])
    return np.concatenate(found), np.concatenate(owner), w.counts


def bucket_counts(texts: DataFrame, *, text_col: str = "text", length: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; tasks count, and the driver gets one row a bucket."""
    C.ship(texts.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in C.blocks(batch, text_col):
                sums += np.bincount(features(*C.text_buffers(C.column(part, text_col)), length, buckets)[0], minlength=buckets)
        some = np.flatnonzero(sums)
        yield C.batch_of(schema, some.astype(np.int32), sums[some])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_col).mapInArrow(C.tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of shares, in thousandths, rounded down."""
    total_s, total_t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.floor(1000 * np.log((target + 1.0) * total_s / ((source + 1.0) * total_t))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1, seed: str = "2024") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    C.ship(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, "text"):
                found, owner, words = features(*C.text_buffers(C.column(part, "text")), length, len(gain))
                n = np.bincount(owner, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, owner, gain[found])
                yield C.batch_of(schema, C.column(part, "id"), words, n, total // np.maximum(n, 1))

    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    return held.mapInArrow(C.tidy(run), "id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)


class Ranges:
    """Ranges of rows in order of descending score and ascending id, of about equal counts."""

    def __init__(self, negated: np.ndarray, cuts: dict[int, np.ndarray]) -> None:
        self.starts, self.cuts = negated, cuts

    def __len__(self) -> int:
        return len(self.starts)

    def of(self, negated: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The range of each row; a null id is given as the least of all."""
        at = np.searchsorted(self.starts, negated, side="right") - 1
        for score, cuts in self.cuts.items():
            mine = np.flatnonzero(negated == score)
            at[mine] = np.searchsorted(self.starts, score, side="left") + np.searchsorted(cuts, ids[mine], side="right")
        return at.astype(np.int32)


def ranges(eligible: DataFrame, histogram: list[tuple[int, int]], most: int) -> Ranges:
    """Ranges of at most `most` rows by the histogram, (score, rows) in descending order; only scores of more rows are cut by ids."""
    heavy = {s: -(-n // most) for s, n in histogram if n > most}
    cuts: dict[int, np.ndarray] = {}
    if heavy:
        parts = max(heavy.values())
        shares = [i / parts for i in range(1, parts)]
        for r in eligible.filter(F.col("score").isin(list(heavy))).groupBy("score").agg(F.percentile_approx("id", shares, 20 * parts).alias("q")).collect():
            wanted = heavy[r["score"]]
            cuts[-r["score"]] = np.unique(np.array([r["q"][i * parts // wanted - 1] for i in range(1, wanted)] if r["q"] else [], np.int64))
    starts: list[int] = []
    room = 0
    for s, n in histogram:
        if n > most:
            starts += [-s] * (len(cuts.get(-s, ())) + 1)
            room = 0
        elif n > room:
            starts.append(-s)
            room = most - n
        else:
            room -= n
    return Ranges(np.array(starts, np.int64), cuts)


#: Columns of a packed row: score negated, whether there is an id, the id, features, weight, repeats.
_NEG, _HAS, _ID, _N, _WEIGHT, _TIMES = range(6)
KEY = ("neg", "has", "id", "n", "weight")


def _sorted_run(rows: np.ndarray) -> np.ndarray:
    """Rows in order, equal ones as one with their number."""
    rows = rows[np.lexsort((rows[:, _WEIGHT], rows[:, _N], rows[:, _ID], rows[:, _HAS], rows[:, _NEG]))]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:, :_TIMES] != rows[:-1, :_TIMES]).any(axis=1)]))
    times = np.add.reduceat(rows[:, _TIMES], first)
    rows = rows[first]
    rows[:, _TIMES] = times
    return rows


def sorted_runs(eligible: DataFrame, cut: Ranges, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(shard, first key, rows, block): blocks of sorted runs, each of one range; the key is neg, has, id, n, weight."""
    schema = pa.schema([("shard", pa.int32()), *((c, pa.int64()) for c in KEY), ("rows", pa.int64()), ("block", pa.binary())])

    def run(batches):
        def flush(parts):
            rows = _sorted_run(np.concatenate(parts))
            shard = cut.of(rows[:, _NEG], np.where(rows[:, _HAS] == 1, rows[:, _ID], np.iinfo(np.int64).min))
            edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist() + [len(rows)]
            at = [(a, min(a + block_rows, b)) for x, b in zip(edge, edge[1:], strict=False) for a in range(x, b, block_rows)]
            for i in range(0, len(at), 64):
                some = at[i : i + 64]
                head = rows[[a for a, _ in some]]
                yield C.batch_of(schema, shard[[a for a, _ in some]], *(head[:, c] for c in range(_TIMES)), np.array([rows[a:b, _TIMES].sum() for a, b in some], np.int64), [rows[a:b].tobytes() for a, b in some])

        held, n = [], 0
        for batch in batches:
            ids = C.column(batch, "id")
            long = lambda name: C.column(batch, name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            rows = np.stack([-long("score"), np.asarray(ids.is_valid()).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), long("n_features"), long("weight"), np.ones(len(ids), np.int64)], axis=1)
            held.append(rows)
            n += len(rows)
            if n >= run_rows:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return eligible.select("id", "n_features", "weight", "score").mapInArrow(C.tidy(run), f"shard int, {', '.join(f'{c} long' for c in KEY)}, rows long, block binary")


class Tournament:
    """Merges sorted blocks: leaves hold the blocks' next keys, every inner node the leaf that wins below it."""

    def __init__(self) -> None:
        self.blocks: list[np.ndarray | None] = [None]
        self.keys: list[tuple | None] = [None]
        self.win = [0, 0]  # win[1] is the root; leaf i is the node len(keys) + i

    def _better(self, a: int, b: int) -> int:
        ka, kb = self.keys[a], self.keys[b]
        return b if ka is None or kb is not None and kb < ka else a

    def _replay(self, leaf: int) -> None:
        n = len(self.keys)
        at = n + leaf >> 1
        while at:
            a, b = (2 * at - n, 2 * at + 1 - n) if 2 * at >= n else (self.win[2 * at], self.win[2 * at + 1])
            self.win[at] = self._better(a, b)
            at >>= 1

    def open(self, block: np.ndarray) -> None:
        free = next((i for i, b in enumerate(self.blocks) if b is None), None)
        if free is None:
            free, n = len(self.blocks), 2 * len(self.blocks)
            self.blocks += [None] * (n - free)
            self.keys += [None] * (n - free)
            self.win = [0] * n
            for leaf in range(0, n, 2):
                self._replay(leaf)
        self.blocks[free], self.keys[free] = block, tuple(block[0, :_TIMES].tolist())
        if len(self.keys) > 1:
            self._replay(free)

    def best(self) -> tuple | None:
        return self.keys[self.win[1] if len(self.keys) > 1 else 0]

    def take(self, limit: tuple | None) -> np.ndarray:
        """Rows of the winner up to the second best key and to limit, at least one; the tree is played again."""
        n = len(self.keys)
        leaf = self.win[1] if n > 1 else 0
        bound, at = limit, n + leaf
        while at > 1:  # the second best lost to the winner somewhere on its way
            other = at ^ 1
            k = self.keys[other - n if other >= n else self.win[other]]
            if k is not None and (bound is None or k < bound):
                bound = k
            at >>= 1
        block = self.blocks[leaf]
        to = len(block) if bound is None else max(_upto(block, bound), 1)
        out, rest = block[:to], block[to:]
        self.blocks[leaf], self.keys[leaf] = (rest, tuple(rest[0, :_TIMES].tolist())) if len(rest) else (None, None)
        if n > 1:
            self._replay(leaf)
        return out


def _upto(block: np.ndarray, key: tuple) -> int:
    """How many rows of a sorted block are at most key."""
    lo, hi = 0, len(block)
    for c, k in enumerate(key):
        col = block[lo:hi, c]
        lo, hi = lo + int(np.searchsorted(col, k, side="left")), lo + int(np.searchsorted(col, k, side="right"))
        if lo == hi:
            return lo
    return hi


class Merge:
    """The rows of blocks in order; blocks come in order of their first keys and are opened when these are due."""

    def __init__(self, blocks: Iterator[np.ndarray]) -> None:
        self.tree, self.blocks = Tournament(), blocks
        self.ahead = next(blocks, None)

    def __iter__(self) -> Iterator[np.ndarray]:
        first = lambda b: None if b is None else tuple(b[0, :_TIMES].tolist())
        due = first(self.ahead)
        while True:
            best = self.tree.best()
            while due is not None and (best is None or due <= best):
                self.tree.open(self.ahead)
                self.ahead = next(self.blocks, None)
                best, due = self.tree.best(), first(self.ahead)
            if best is None:
                return
            yield self.tree.take(due)

    def rest(self) -> Iterator[np.ndarray]:
        """What isn't merged yet, in no order."""
        yield from (b for b in self.tree.blocks if b is not None)
        if self.ahead is not None:
            yield self.ahead
            yield from self.blocks


def _rows(block: bytes) -> np.ndarray:
    return np.frombuffer(block, np.int64).reshape(-1, _TIMES + 1)


def draw(rows: DataFrame, *, percent: int = 10, min_words: int = 20, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of scored(); rank is null for those that aren't drawn."""
    spark = rows.sparkSession
    path = C.shared_dir(spark)
    rows = C.stored(rows, f"{path}/scored")
    columns = "id", "n_features", "weight", "score"
    eligible = rows.filter(F.col("n_words") >= min_words)
    histogram = sorted(((r["score"], r["n"]) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in histogram) * percent // 100
    unranked = lambda which: rows.filter(which).select(*columns, F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return unranked(F.lit(True))
    reach, last = 0, 0
    while reach < wanted:
        reach += histogram[last][1]
        last += 1
    chosen = (F.col("n_words") >= min_words) & (F.col("score") >= histogram[last - 1][0])
    cut = ranges(rows.filter(chosen), histogram[:last], min(range_rows, -(-reach // C.width(spark))))
    runs = C.stored(sorted_runs(rows.filter(chosen), cut, run_rows, block_rows), f"{path}/runs")
    sizes = np.zeros(len(cut), np.int64)
    for r in runs.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
        sizes[r["shard"]] = r["n"]
    before = np.cumsum(sizes) - sizes
    n_open = int(np.searchsorted(before, wanted, side="left"))  # later ranges hold nothing that is drawn
    schema = pa.schema([*((c, pa.int64()) for c in columns), ("before", pa.int64()), ("times", pa.int64())])

    def packed(part: np.ndarray, done: int | None) -> pa.RecordBatch:
        """done: rows drawn before part; None if part isn't drawn."""
        ahead = pa.nulls(len(part), pa.int64()) if done is None else done + np.cumsum(part[:, _TIMES]) - part[:, _TIMES]
        return C.batch_of(schema, pa.array(part[:, _ID], mask=part[:, _HAS] == 0), part[:, _N], part[:, _WEIGHT], -part[:, _NEG], ahead, part[:, _TIMES])

    def merge(batches):
        blocks = ((s, _rows(b)) for batch in batches for s, b in zip(C.column(batch, "shard").to_pylist(), C.column(batch, "block").to_pylist(), strict=True))
        for shard, own in itertools.groupby(blocks, lambda x: x[0]):
            whole, done, held, n = Merge(b for _, b in own), int(before[shard]), [], 0
            for part in whole:
                held.append(part)
                n += int(part[:, _TIMES].sum())
                if len(held) >= 4096 or done + n >= wanted:
                    yield packed(np.concatenate(held), done)
                    done, held, n = done + n, [], 0
                    if done >= wanted:
                        break
            if held:
                yield packed(np.concatenate(held), done)
            for part in whole.rest():
                yield packed(part, None)

    def unpack(batches):
        for batch in batches:
            for b in C.column(batch, "block").to_pylist():
                yield packed(_rows(b), None)

    kinds = ", ".join(f"{f.name} long" for f in schema)
    drawn = ordered.dealt(runs.filter(F.col("shard") < n_open), n_open).sortWithinPartitions("shard", *KEY).mapInArrow(C.tidy(merge), kinds)
    late = runs.filter(F.col("shard") >= n_open).mapInArrow(C.tidy(unpack), kinds)
    each = drawn.unionByName(late).select(*columns, "before", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
    rank = F.col("before") + F.col("time")
    return each.select(*columns, F.when(rank <= wanted, rank).alias("rank")).unionByName(unranked(~chosen))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", length: int = 1, buckets: int = BUCKETS, seed: str = "2024", **options) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document, drawn towards the distribution of target's texts; options: those of draw()."""
    gain = gains(bucket_counts(docs, text_col=text_col, length=length, buckets=buckets), bucket_counts(target, text_col=target_col, length=length, buckets=buckets))
    return draw(scored(docs, gain, id_col=id_col, text_col=text_col, length=length, seed=seed), **options)


def op11_resample(spark, sf_dir: str) -> DataFrame:
    """The tenth of documents that is most like benchmark, with ranks, among all documents."""
    out = resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the table by its rule, then a step a byte.
CRC_TABLE = "(SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(i)))"
CRC_OF = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode({x}))), lambda k: CAST('0x' || substr(hex(encode({x})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))), lambda a, b: xor(a >> 8, crc[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295)"
ORACLE = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dx AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM dw) GROUP BY ALL),
bx AS (SELECT x, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark) GROUP BY x),
word AS (SELECT x, {CRC_OF.format(x="x")} % 10000 AS bucket FROM (SELECT x FROM dx UNION SELECT x FROM bx), {CRC_TABLE}),
s AS (SELECT bucket, sum(n) AS s FROM dx JOIN word USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bx JOIN word USING (x) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS big_s, coalesce((SELECT sum(t) FROM t), 0) AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM word) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dx JOIN word USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
noise AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS z FROM dw LEFT JOIN weighed USING (doc_id)),
best AS (SELECT doc_id, row_number() OVER (ORDER BY weight + z DESC, doc_id) AS k FROM noise WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + z AS score, CASE WHEN k <= 10 * (SELECT count(*) FROM best) // 100 THEN k END AS rank FROM noise LEFT JOIN best USING (doc_id)
"""
