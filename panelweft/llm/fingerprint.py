"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k least distinct hashes of a text's shingles (runs of `shingle` bytes; a
shorter text is one shingle, an empty one has none).  Sketches of parts merge into the
sketch of the whole, and estimate resemblance, containment and the number of distinct
shingles.  Sketches with fewer than k hashes are the whole set, so their estimates are exact.

The query joins each document with its neighbour in identifier order by dealing rows to
range shards; the first row of each shard is also sent to the shard before it.  A task
streams its shard with one row held back, so it holds two texts at a time.

Null texts are empty texts.  Equal identifiers are ordered by text, and each repeated row
has its own result.  Null identifiers come last in descending order.  Extra columns don't
matter; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C
from panelweft.llm import ordered

K = 128
SHINGLE = 12
#: Bits of a hash that a sketch keeps.
BITS = 48
SPAN = float(1 << BITS)


def shingle_hashes(data: bytes | np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes (of BITS bits) of all shingles of one text."""
    b = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if not len(b):
        return np.zeros(0, np.uint64)
    values = C.PLAIN.values[b]
    return C.grams(values, min(shingle, len(b))) >> np.uint64(64 - BITS)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, ascending."""
    if len(hashes) > 8 * k:
        # Repeats may leave fewer than k distinct hashes below a quantile; then the net is widened.
        take = 4 * k
        while take < len(hashes):
            low = np.unique(np.partition(hashes, take)[: take + 1])
            if len(low) > k:
                return low[:k]
            take *= 4
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) * SPAN / float(s[k - 1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike."""
    u = merged(a, b, k)
    if not len(u):
        return 1.0
    return float((np.isin(u, a) & np.isin(u, b)).sum() / len(u))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    j, na, nb = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return 1.0 if na == 0 else min(1.0, j * (na + nb) / (1 + j) / na)


def to_text(s: np.ndarray) -> str:
    """A sketch as text: its hashes' BITS // 8 low bytes, big-endian, in base64."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes()).decode()


def from_text(t: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(t), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """(id_col, fingerprint, n_shingles): each text's sketch as text and its estimated distinct shingles."""
    C.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, text_col):
                data, offsets = C.text_buffers(C.column(part, text_col))
                s = [sketch(shingle_hashes(data[a:b], shingle), k) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([C.column(part, id_col), pa.array(map(to_text, s), pa.string()), pa.array([distinct(x, k) for x in s])], [id_col, "fingerprint", "n_shingles"])

    return docs.select(id_col, text_col).mapInArrow(C.tidy(run), f"`{id_col}` {kind}, fingerprint string, n_shingles double")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """Each document's fingerprint, that of its edited text, its likeness to that and to the next document (descending id), its number of distinct shingles and their share in the edited text; likenesses, number and share are estimates."""
    spark = docs.sparkSession
    C.ship(spark)
    n = C.width(spark)
    cuts = ordered.bounds(docs, id_col, n)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    heads = _heads(ids, cuts)
    present = sorted(heads, reverse=True)
    # The first row of a shard (its greatest id) follows the last row of the next shard above it that has rows.
    also = {heads[own]: above for above, own in zip(present[-1:] + present[:-1], present, strict=True)}
    rows = ordered.dealt(ordered.packed(docs, id_col, text_col, cuts, also), max(n, len(cuts) + 1)).sortWithinPartitions("shard", "extra", F.col("id").desc_nulls_last(), "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "in_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        held = None  # (shard, id, text, sketch) of the row that waits for the next one
        first = None  # of the shard, where its own first row is what follows its last
        out = []

        def judged(row, following):
            _, i, text, s = row
            e = edited(text, following[2])
            es = sketch(shingle_hashes(e.encode(), shingle), k)
            return i, len(text), hashlib.sha256(e.encode()).hexdigest(), to_text(s), to_text(es), resemblance(s, es, k), resemblance(s, following[3], k), distinct(s, k), containment(s, es, k)

        for batch in batches:
            for part in C.blocks(batch, "text", 1 << 20):
                for sh, extra, i, raw in zip(C.column(part, "shard").to_pylist(), C.column(part, "extra").to_pylist(), C.column(part, "id").to_pylist(), ordered.unpacked(C.column(part, "text")), strict=True):
                    row = (sh, i, raw.decode(), sketch(shingle_hashes(raw, shingle), k))
                    if held is not None and held[0] == sh:
                        out.append(judged(held, row))
                        held = None if extra else row
                    elif not extra:
                        if held is not None:
                            out.append(judged(held, first))
                        held = first = row
                if out:
                    yield C.batch_of(schema, *map(list, zip(*out, strict=True)))
                    out = []
        if held is not None:
            yield C.batch_of(schema, *map(list, zip(judged(held, first), strict=True)))

    done = rows.mapInArrow(C.tidy(run), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, in_edited double")
    return done.withColumnRenamed("id", id_col)


def _heads(ids: DataFrame, cuts: np.ndarray) -> dict[int, int | None]:
    """The greatest identifier of each shard that has rows (None: it has null ones only); one row for each shard."""
    schema = pa.schema([("shard", pa.int32()), ("id", pa.int64())])

    def run(batches):
        best: dict[int, int | None] = {}
        for batch in batches:
            at = ordered.shard_of(batch.column(0), cuts)
            for s, i in zip(at.tolist(), batch.column(0).to_pylist(), strict=True):
                old = best.get(s)
                best[s] = i if old is None else old if i is None else max(old, i)
        yield C.batch_of(schema, list(best), list(best.values()))

    got = ids.mapInArrow(C.tidy(run), "shard int, id long").groupBy("shard").agg(F.max("id").alias("id")).collect()
    return {r["shard"]: r["id"] for r in got}


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    """The contract's columns from neighbours() over documents."""
    return neighbours(C.table(spark, sf_dir, "documents"))
