"""A stored inverted index, and searches that read only what can still reach the best results.

Postings lie in folders by a hash of their term, as blocks of a term, a level of impact and at
most BLOCK documents of a segment (documents that one task inverted together).  A posting's impact is what it adds to a document's score for each unit of its
term's weight: (1 + ln tf), times the boosts of terms in titles and summaries.

A search reads the numbers of its terms' levels first.  The documents of a term's best levels
have at least what that term alone adds, so the `top`-th best score is at least known to be
above a threshold.  A level whose greatest impact, with the other terms' greatest impacts,
stays below it holds no document of the result, and its blocks are never read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.functions.exprs import tokens
from panelweft.operators.text import postings
from panelweft.session import ship, stored

#: Folders of an index, documents of a block, and levels of one unit of impact.
BUCKETS, BLOCK, LEVELS = 64, 1024, 8
#: Tokens that a task inverts together, and blocks that it sends in a batch.
SEGMENT, SENT = 1 << 22, 1 << 14
#: Scores are rounded to so many digits before they are compared, as in text.search().
DIGITS = 3


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _segment(batches: list[pa.RecordBatch], block: int, boosts: Sequence[float]) -> pa.RecordBatch:
    """Blocks (term, level, n, low, high, id, impact) of all postings of the documents (id, terms, each, and the terms that a boost goes to); each: what an occurrence of a term counts."""
    docs = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    ids, terms, each = docs.column(0), docs.column(1), np.asarray(docs.column(2), np.int64)
    words = terms.flatten().dictionary_encode()
    many = max(1, len(words.dictionary))

    def keys(lists: pa.ListArray, codes) -> np.ndarray:
        """A number for each document and word."""
        return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64)) * many + codes

    found, tf = np.unique(keys(terms, np.asarray(words.indices, np.int64)), return_counts=True)
    doc, code = np.divmod(found, many)
    counts, place = np.unique(tf * each[doc], return_inverse=True)
    impact = np.array([1 + math.log(n) for n in counts.tolist()])[place]
    for lists, boost in zip(docs.columns[3:], boosts, strict=True):
        codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=words.dictionary), -1)
        named = keys(lists, np.asarray(codes, np.int64))[np.asarray(codes) >= 0]
        impact = np.where(np.isin(found, named), impact * boost, impact)
    level = np.floor(impact * LEVELS).astype(np.int64)
    group = code * (level.max(initial=0) + 1) + level
    order = np.argsort(group, kind="stable")
    opens = np.concatenate([[True], np.diff(group[order]) != 0])[: len(order)]
    at = np.arange(len(order))
    opens |= (at - np.maximum.accumulate(np.where(opens, at, 0))) % block == 0
    first = np.flatnonzero(opens)
    impact = impact[order]
    bounds = pa.array(np.append(first, len(order)).astype(np.int32))
    low, high = (f.reduceat(impact, first) if len(first) else impact for f in (np.minimum, np.maximum))
    lead = order[first]
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(pa.array(code[lead])), pa.array(level[lead].astype(np.int32)), pa.array(np.diff(np.append(first, len(order))).astype(np.int32)), pa.array(low), pa.array(high), pa.ListArray.from_arrays(bounds, ids.take(pa.array(doc[order]))), pa.ListArray.from_arrays(bounds, pa.array(impact))],
        ["term", "level", "n", "low", "high", "id", "impact"],
    )


def _blocks(rows: DataFrame, block: int, boosts: Sequence[float], segment: int) -> DataFrame:
    """_segment() of a task's documents, of some `segment` tokens at a time: memory is bounded, and postings are never rows."""
    ship(rows.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += len(batch.column(1).flatten())
            if held and (batch is None or size >= segment):
                out, held, size = _segment(held, block, boosts), [], 0
                for at in range(0, out.num_rows, SENT):
                    yield out.slice(at, SENT)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"term string, level int, n int, low double, high double, id array<{kind}>, impact array<double>")


def build(docs: DataFrame, path: str, *, id_col: str, text_col: str, title_col: str | None = None, summary_col: str | None = None, title_boost: float = 2.0, summary_boost: float = 1.5, buckets: int = BUCKETS, block: int = BLOCK, segment: int = SEGMENT) -> None:
    """Write the index of docs under path. Documents without a term count as documents; those of one id are one to a search.

    Each task inverts its own documents, a segment at a time, so that blocks are shuffled and
    not postings: once, to the folder of their term, over as many tasks as there are.
    """
    extra = [(c, boost) for c, boost in ((title_col, title_boost), (summary_col, summary_boost)) if c]
    again = stored(docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    once, several = docs, None
    if not again.isEmpty():
        same = docs[id_col].eqNullSafe(again["id"])
        once, several = docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")
    rows = once.select(F.col(id_col).alias("id"), tokens(text_col).alias("terms"), F.lit(1).cast("long").alias("each"), *[tokens(c).alias(f"in_{i}") for i, (c, _) in enumerate(extra)])
    if several is not None:
        own = postings(several, id_col, text_col, title_col, summary_col)
        flags = [f for c, f in ((title_col, "in_title"), (summary_col, "in_summary")) if c]
        rows = rows.unionByName(own.select(F.col(id_col).alias("id"), F.array("term").alias("terms"), F.col("tf").alias("each"), *[F.filter(F.array("term"), lambda _, f=f: F.col(f)).alias(f"in_{i}") for i, f in enumerate(flags)]))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = -(-width // buckets)
    blocks = _blocks(rows, block, [boost for _, boost in extra], segment).withColumn("bucket", _bucket("term", buckets))
    # A term's blocks go to `spread` tasks, by their first documents.
    part = F.col("bucket") * spread + F.pmod(F.xxhash64("term", F.get("id", 0)), F.lit(spread)).cast("int")
    placed = blocks.repartitionById(width, F.pmod(part, F.lit(width))).sortWithinPartitions("bucket", "term", "level")
    placed.select("term", "level", "n", "low", "high", F.arrays_zip("id", "impact").alias("postings"), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.agg(F.count("*").alias("n_docs")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/about")


def kept_levels(levels: list[tuple[str, int, int, float, float]], weights: dict[str, float], top: int) -> list[tuple[str, int]]:
    """The (term, level) that a document of the result may be in; levels: (term, level, documents, least and greatest impact)."""
    threshold = -math.inf
    for t in weights:
        n = 0
        for _, _, m, low, _ in sorted((x for x in levels if x[0] == t), key=lambda x: -x[1]):
            n += m
            if n >= top:
                threshold = max(threshold, weights[t] * low)
                break
    best = {t: weights[t] * max((x[4] for x in levels if x[0] == t), default=0.0) for t in weights}
    slack = 2 * 10**-DIGITS  # rounded scores may tie
    return [(t, level) for t, level, _, _, high in levels if weights[t] * high + sum(best.values()) - best[t] >= threshold - slack]


def search(spark: SparkSession, path: str, query: str, *, top: int = 20) -> DataFrame:
    """(id, score): what text.search() gives with the index's boosts, from the buckets of the query's terms."""
    about = spark.read.parquet(f"{path}/about").first()
    times = {r["term"]: r["times"] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(tokens("q")).alias("term")).groupBy("term").agg(F.count("*").alias("times")).collect()}
    index = spark.read.parquet(f"{path}/postings")
    none = index.select(F.inline("postings")).select("id", F.lit(0.0).alias("score")).limit(0)
    if not times:
        return none
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in times], "term string").select(_bucket("term", about["buckets"])).distinct().collect()]
    mine = index.filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(times)))
    # A row a level of a term: levels are as many as the logarithm of the longest document.
    levels = [tuple(r) for r in mine.groupBy("term", "level").agg(F.sum("n"), F.min("low"), F.max("high")).collect()]
    if not levels:
        return none
    found = {t: sum(x[2] for x in levels if x[0] == t) for t in {x[0] for x in levels}}
    weights = {t: times[t] * math.log(about["n_docs"] / n) for t, n in found.items()}
    kept = kept_levels(levels, weights, top)
    chosen = F.lit(False)
    for t in weights:
        chosen = chosen | (F.col("term") == t) & F.col("level").isin([level for x, level in kept if x == t])
    weight = F.create_map(*[F.lit(x) for t in weights for x in (t, weights[t])])
    parts = mine.filter(chosen).select("term", F.inline("postings")).select("id", (F.col("impact") * weight[F.col("term")]).alias("part"))
    return parts.groupBy("id").agg(F.round(F.sum("part"), DIGITS).alias("score")).orderBy(F.desc("score"), "id").limit(top)
