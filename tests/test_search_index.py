"""Searches of the stored index against the full scan."""

import math
import random

from pyspark.sql import functions as F

from panelweft.operators import search_index, text


def test_index_is_the_full_scan(spark, tmp_path):
    rng = random.Random(4)
    vocab = [f"term{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    data = [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(0, 40)) * rng.choice([1, 1, 1, 4])), " ".join(rng.choices(vocab, k=2)), rng.choice([None, "term0 term3"])) for i in range(400)]
    docs = spark.createDataFrame(data, "id long, body string, title string, summary string")
    path = f"{tmp_path}/index"
    search_index.build(docs, path, id_col="id", text_col="body", title_col="title", summary_col="summary", buckets=16, block=5)
    for query in ("term0", "term1 term2", "term0 term7 term0 term30", "term59", "term0 unknown", "unknown", "", "the of"):
        for top in (1, 5, 20, 1000):
            want = text.search(docs, query, id_col="id", text_col="body", title_col="title", summary_col="summary", top=top).collect()
            assert [tuple(r) for r in search_index.search(spark, path, query, top=top).collect()] == [tuple(r) for r in want], (query, top)


def test_a_search_reads_its_buckets_and_levels_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common " * (1 + i % 30) + " rare" * (i % 60 * (i % 2)) + f" w{i}") for i in range(600)], "id long, body string")
    path = f"{tmp_path}/index"
    search_index.build(docs, path, id_col="id", text_col="body", buckets=32, block=10)
    index = spark.read.parquet(f"{path}/postings")
    levels = [tuple(r) for r in index.filter("term IN ('rare', 'common')").groupBy("term", "level").agg(F.sum("n"), F.min("low"), F.max("high")).collect()]
    weights = {"rare": 3.9, "common": 0.1}
    kept = search_index.kept_levels(levels, weights, 5)
    read = sum(n for t, level, n, *_ in levels if (t, level) in kept)
    assert {t for t, _ in kept} == {"rare", "common"} and read < 0.8 * sum(x[2] for x in levels)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = search_index.search(spark, path, "rare", top=5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan and "PushedFilters: [" in plan and "term" in plan


def test_postings_are_shuffled_as_blocks(spark):
    """No row for each posting leaves a task, and no posting is lost where segments or blocks end."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, words[: 1 + i % 40] * (1 + i % 3), 1) for i in range(3000)] + [(3000, [], 1)], "id long, terms array<string>, each long").repartition(2)
    want = {(t, i): 1 + math.log(1 + i % 3) for i in range(3000) for t in words[: 1 + i % 40]}
    for segment, block, most in ((1 << 22, 1024, 2 * 40 * 3 * 2), (5000, 7, len(want) // 3)):
        rows = search_index._blocks(docs, block, [], segment).collect()
        assert len(rows) <= most and sum(r["n"] for r in rows) == len(want)
        assert {(r["term"], i): x for r in rows for i, x in zip(r["id"], r["impact"], strict=True)} == want
        assert all(r["n"] == len(r["id"]) <= block and r["low"] == min(r["impact"]) and r["high"] == max(r["impact"]) and {math.floor(x * search_index.LEVELS) for x in r["impact"]} == {r["level"]} for r in rows)


def test_repeated_and_null_ids_are_one_document_each(spark, tmp_path):
    data = [(1, "apple apple pear"), (1, "apple fig"), (None, "pear pear"), (None, "pear apple"), (2, ""), (3, None), (4, "fig fig fig pear"), (5, "apple")]
    docs = spark.createDataFrame(data, "id long, body string")
    search_index.build(docs, f"{tmp_path}/index", id_col="id", text_col="body", buckets=4, block=2, segment=2)
    for query in ("apple pear", "fig pear pear"):
        want = text.search(docs, query, id_col="id", text_col="body").collect()
        assert [tuple(r) for r in search_index.search(spark, f"{tmp_path}/index", query).collect()] == [tuple(r) for r in want]
