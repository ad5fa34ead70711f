"""Resampling, conversation repair and quality rules on small and awkward tables, against brute force and SQL."""

import hashlib
import heapq
import math
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import close, rows

from panelweft.llm import conversation, quality, resample

WORDS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, n_words long, stratum string, score long, rank long, conv string, _h string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    rnd = random.Random(3)
    texts = [None, "", " \n ", "one two", "Ünï! 語 x\tY", "w" * 300 + " b", " ".join(f"v{i % 50}" for i in range(3000))]
    texts += [" ".join(rnd.choice("the of and zoo rare Word x9 é".split()) for _ in range(rnd.randrange(0, 60))) for _ in range(40)]
    data = [(i, t, None, 1, "s", 1, 1, "c", "h") for i, t in enumerate(texts)]
    data += data[3:8] + [data[20]] * 30 + [(None, texts[20], "en", 1, "s", 1, 1, "c", "h")] * 3
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def resample_truth(docs, target, length, buckets, percent, min_words):
    def feats(t):
        w = re.findall(ALNUM, lower(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, length + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in docs:
        np.add.at(s, feats(x)[1], 1)
    for x in target:
        np.add.at(t, feats(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    can = sorted((x for x in out if x[0] >= min_words), key=lambda x: (-x[4], x[1] is not None, x[1] or 0, x[2], x[3]))
    drawn = can[: len(can) * percent // 100]
    rest = can[len(drawn) :] + [x for x in out if x[0] < min_words]
    return sorted([(*x[1:], k + 1) for k, x in enumerate(drawn)] + [(*x[1:], None) for x in rest], key=repr)


@pytest.mark.parametrize("length,percent,sizes", [(1, 10, {}), (2, 60, {"range_rows": 3, "run_rows": 7, "block_rows": 2}), (3, 100, {"range_rows": 1, "run_rows": 5, "block_rows": 1}), (1, 0, {})])
def test_resample(spark, odd, length, percent, sizes):
    target = spark.createDataFrame([("the zoo the word",), (None,), ("rare rare of",)], "text string")
    got = resample.resample(odd, target, length=length, buckets=97, percent=percent, min_words=10, **sizes).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted([tuple(r) for r in got], key=repr) == resample_truth(docs, ["the zoo the word", None, "rare rare of"], length, 97, percent, 10)


def test_resample_of_nothing(none, odd):
    assert resample.resample(none, none).collect() == []
    assert all(r["weight"] <= 0 for r in resample.resample(odd, none.select("text")).filter("n_features = 0").collect())


def test_one_score_of_many_ids(spark):
    """A score that alone exceeds a range is cut by ids, and ranks follow them."""
    made = spark.createDataFrame([(i * 7 % 1000, 30, 30, 5, 100) for i in range(1000)] + [(None, 30, 30, 5, 100)] * 4, "id long, n_words long, n_features long, weight long, score long")
    got = sorted(resample.draw(made, percent=50, range_rows=40, run_rows=64, block_rows=8).filter("rank IS NOT NULL").collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 503))
    assert [r["id"] for r in got] == [None] * 4 + list(range(498))


def test_tournament():
    for seed in range(200):
        rnd = random.Random(seed)
        all_rows = np.array([[rnd.randrange(6), 1, rnd.randrange(8), rnd.randrange(2), 0, 1] for _ in range(rnd.randrange(1, 60))], np.int64)
        blocks, i = [], 0
        while i < len(all_rows):
            j = i + rnd.randrange(1, 12)
            run, k = resample._sorted_run(all_rows[i:j]), 0
            while k < len(run):
                m = k + rnd.randrange(1, 5)
                blocks.append(run[k:m])
                k = m
            i = j
        blocks.sort(key=lambda b: tuple(b[0, :5].tolist()))
        got = np.concatenate(list(resample.Merge(iter(blocks))))
        assert [tuple(x[:5]) for x in got.tolist() for _ in range(x[5])] == [tuple(x[:5]) for x in sorted(all_rows.tolist())]


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        words = re.findall(WORDS, text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1][-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(turns):
    """The least cost and, among its audits, the ASCII-least, by search over all edit sequences."""
    found, n = faults(turns), len(turns)
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == n and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        if len(out) > 2 * n + 3 or not re.match("s?(ua)*u?$", out):
            continue
        if i < n:
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if found[i] not in ("blank", "duplicate"):
                x = cost + 3 * (found[i] == "truncated")
                heapq.heappush(heap, (x, audit + "K", i + 1, out + (turns[i][1][:1] or "?")))
                for r in "ua":
                    heapq.heappush(heap, (x + 3, audit + "R", i + 1, out + r))
        for r in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, out + r))


def random_turns(rnd, n):
    return [(i, rnd.choice(["system", "user", "assistant", "tool", ""]), rnd.choice(["Hi.", "Yo", "", " ", "Ok!", "abc?", "z"])) for i in range(n)]


def test_repair_is_cheapest_and_least():
    rnd, machine = random.Random(5), conversation.Repairer()
    for _ in range(600):
        turns = random_turns(rnd, rnd.randrange(0, 6))
        found = conversation._summary(machine, turns)
        assert (found[5], found[6]) == cheapest(turns)
        assert list(found[1:4]) == [faults(turns).count(f) for f in ("blank", "duplicate", "truncated")]
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in found[7]))
    assert len(machine.vectors) < 100  # the automaton doesn't grow with the data


def test_repair_tables(spark, monkeypatch):
    """Nulls, repeats, equal turns, conversations without rows; long ones in chunks give the same."""
    rnd = random.Random(7)
    data = [(c, rnd.choice([None, *range(40)]), rnd.choice(["system", "user", "assistant", "tool", None]), rnd.choice(["Hi.", "Yo", "", None, "Ok!", "abc?", *[f"t{i}." for i in range(30)]]), rnd.choice([0, 1, 1, 1, 2, 5]), "x", "y") for c in [1] * 120 + [2] * 3 + [None] * 90 + [3] * 40]
    data += [(4, 0, "user", "Hi.", 0, "x", "y"), (5, None, "user", "Hi.", 1, "x", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, times int, conv string, turns string")
    whole = {r["conv_id"]: r for r in conversation.repair(df, times_col="times").collect()}
    assert set(whole) == {1, 2, 3, 4, 5, None}
    assert tuple(whole[4])[1:] == (0, 0, 0, 0, 0, 0, "", []) and whole[5]["gaps"] == 0 and whole[5]["audit"] == "KI"
    for c, r in whole.items():
        own = [(t, role or " ", " " if text is None else text) for cc, t, role, text, n, *_ in data if cc == c for _ in range(n)]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert tuple(r)[2:5] == tuple(faults(own).count(f) for f in ("blank", "duplicate", "truncated"))
    for size in (3, 4096):
        monkeypatch.setattr(conversation, "CHUNK_ROWS", size)
        assert {r["conv_id"]: r for r in conversation.repair(df, times_col="times", long_rows=20).collect()} == whole
    assert conversation.repair(df.limit(0)).collect() == []


def measured(t):
    w = re.findall(WORDS, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(WORDS, x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(twice)


def test_measures(spark, odd, none):
    more = spark.createDataFrame([(100, "a b c d e x a b c d e a b c d e\n\na b\na b\n| # |", None, 1, "s", 1, 1, "c", "h"), (101, "z " * 40, None, 1, "s", 1, 1, "c", "h")], SCHEMA)
    docs = odd.unionByName(more).filter("doc_id <> 6")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality.measures(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measured(texts[r["id"]])
    cuts = quality.certify(quality.measures(none), none.selectExpr("doc_id", "1 AS quality"))
    assert cuts.count() == 0 and quality.judge(quality.measures(none), cuts).count() == 0
    judged = quality.judge(quality.measures(odd), cuts)
    assert judged.count() == odd.count() and judged.filter("kept = base_failed").count() == 0


def tail(n, k, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    cases = [(1, 0), (10, 0), (300, 2), (300, 14), (5000, 30), (900, 44), (900, 45)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(quality.F.col("n"), quality.F.col("k"), 0.05).alias("p"))
    for n, k, p in df.collect():
        assert p == pytest.approx(tail(n, k, 0.05) if k < n * 0.05 else 1.0, rel=1e-9)


@pytest.fixture(scope="module")
def labelled():
    """Three strata: clean, noisy good texts (nothing to certify below their noise), and one with few labels."""
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(2600):
        lang = ("aa", "bb", None)[0 if i < 1300 else 1 if i < 2500 else 2]
        good = rnd.random() < 0.85
        words = [rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) + str(rnd.randrange(1000)) for _ in range(30)]
        if not good or lang == "bb" and rnd.random() < 0.1:
            words = [w + "##" for w in words]
        docs.append((i, " ".join(words), lang))
        labels.append((i, int(good)))
    labels += [(0, 0), (1, None), (None, 1)]
    docs += [docs[5], docs[6], (None, docs[7][1], "aa"), (5000, None, "aa"), (5001, "", None)]
    return docs, labels


def test_certified_cutoffs(spark, labelled, tmp_path):
    docs, labels = labelled
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op13_quality(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    known = got[got["doc_id"].notna() & ~got["doc_id"].isin([5, 6])]  # SQL joins on the id, which two rows repeat
    want = con.execute(quality.ORACLE).df()
    close(rows(known), rows(want[want["doc_id"].notna() & ~want["doc_id"].isin([5, 6])]))
    counts = quality.measures(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    cuts = {(r["stratum"]["lang"], r["rule"]): r for r in quality.certify(counts, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert cuts["aa", "symbols"]["cutoff"] <= 150 and cuts["bb", "symbols"]["cutoff"] >= 200
    assert not any(lang is None for lang, _ in cuts)
    for r in cuts.values():
        assert r["p_value"] == pytest.approx(tail(r["n"], r["rejected"], 0.01), rel=1e-9) and r["p_value"] <= 0.05 / 15
    bad = dict(labels)
    lost = got[(got["doc_id"] < 1300) & ~got["kept"]]["doc_id"]
    assert len(lost) > 150 and sum(bad[i] == 1 for i in lost) <= 2


def test_false_rejections_stay_limited():
    """Over draws of labels whose true rate is at the limit, a cutoff is certified in at most delta of them."""
    rng, n, p, level = np.random.default_rng(0), 800, 0.01, 0.05
    critical = max((k for k in range(20) if tail(n, k, p) <= level), default=-1)
    assert (rng.binomial(n, p, 20000) <= critical).mean() <= level * 1.15
