"""Documents dealt to tasks by ranges of their identifiers, without a sampling pass over their texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C


def bounds(docs: DataFrame, id_col: str, n: int) -> np.ndarray:
    """At most n - 1 identifiers that cut the rows into ranges of about equal counts; only the id column is read."""
    if n < 2:
        return np.zeros(0, np.int64)
    got = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)], 20 * n)).first()[0]
    return np.unique(np.array(got or [], np.int64))


def shard_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """The range of each identifier; nulls come before all others."""
    wide = ids.cast(pa.int64())
    at = np.searchsorted(cuts, wide.fill_null(0).to_numpy(zero_copy_only=False), side="right")
    at[np.asarray(wide.is_null())] = 0
    return at.astype(np.int32)


def packed(docs: DataFrame, id_col: str, text_col: str, cuts: np.ndarray, also: dict[int | None, int] | None = None) -> DataFrame:
    """(shard, extra, id, text): texts compressed for the shuffle, each in its range's shard.

    also: identifiers whose rows go to one more shard each, marked extra (of null ones, each block's least).
    """
    twice = also or {}
    schema = pa.schema([("shard", pa.int32()), ("extra", pa.bool_()), ("id", pa.int64()), ("text", pa.binary())])

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        keys = np.array(sorted(i for i in twice if i is not None), np.int64)
        for batch in batches:
            for part in C.blocks(batch, text_col):
                data, offsets = C.text_buffers(C.column(part, text_col))
                raw = memoryview(data)
                text = [z.compress(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                ids = C.column(part, id_col).cast(pa.int64())
                yield C.batch_of(schema, shard_of(ids, cuts), np.zeros(len(text), bool), ids, text)
                null = np.asarray(ids.is_null())
                hit = np.flatnonzero(np.isin(ids.fill_null(-1).to_numpy(zero_copy_only=False), keys) & ~null)
                if None in twice and null.any():
                    hit = np.append(hit, min(np.flatnonzero(null), key=text.__getitem__))
                if len(hit):
                    own = [ids[int(i)].as_py() for i in hit]
                    yield C.batch_of(schema, np.array([twice[i] for i in own], np.int32), np.ones(len(hit), bool), own, [text[i] for i in hit])

    return docs.select(id_col, text_col).mapInArrow(C.tidy(run), "shard int, extra boolean, id long, text binary")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows with shard i in partition i."""
    return rows.repartitionById(n, F.col("shard"))


def unpacked(part: pa.Array) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) if len(x) else b"" for x in part.to_pylist()]
