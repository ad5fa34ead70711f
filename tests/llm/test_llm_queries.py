"""Each operator on small and awkward tables against brute force."""

import base64
import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import close, duck, rows

from panelweft.llm import bpe, decontaminate, fingerprint, language, neardup, pii, queries, sstable, substrings, toxicity, warc
from panelweft.llm import common as C

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, id string"
LONG = " ".join(f"w{i * i % 977}" for i in range(6000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns with names that the operators use themselves."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word59", "other")
    texts = [base, near, base, None, "", " \n ", "one two", "one two", LONG, LONG + " more", "For " * 50, base + " " + base, "123 !!", "a@b.org 10.0.0.1"]
    data = [(i, t, "en" if i % 3 else "de", "s", len(t or ""), i, "k", "x") for i, t in enumerate(texts)]
    data += [data[0], (None, base, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, fold=False):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t) if fold else t)


def test_oracles(spark):
    con = duck(SF)
    for name, sql in queries.ORACLES.items():
        close(rows(queries.QUERIES[name](spark, SF).toPandas()), rows(con.execute(sql).df()))


def substring_truth(pairs):
    seen, out = {}, {}
    order = sorted(pairs, key=lambda p: (-(1 << 63) if p[0] is None else p[0]))
    done = set()
    for i, t in order:
        if (i, t) in done:
            continue
        done.add((i, t))
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            else:
                seen[g] = (i, k)
        out[i, t] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(spark, odd, none, hot):
    got = substrings.deduplicate(odd, hot_segments=hot).collect()
    truth = substring_truth([(r["doc_id"], r["text"]) for r in odd.collect()])
    by_id = {i: v for (i, _), v in truth.items()}
    assert len(got) == odd.count()
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == by_id[r["doc_id"]]
        assert sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"]
    assert substrings.deduplicate(none).count() == 0


def test_substrings_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = substring_truth([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.QUERIES["op1_substrings"](spark, SF).collect()}
    assert got == {i: v for (i, _), v in truth.items()}


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(2, "Word3 word4 WORD5 word6 word7 word8 word9 word10 word11 word12 word13"), (10, "one two"), (3, None), (4, ""), (5, "one two")], "item_id int, text string")
    for most in (200_000, 1):
        got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.decontaminate(odd, bench, max_broadcast_windows=most).collect()}
        assert got[0, 60]["n_hit"] == 11 and got[0, 60]["items"] == "2"
        assert got[6, 2]["items"] == "10,5" and got[6, 2]["n_hit"] == 2
        assert not got[3, 0]["contaminated"] and not got[8, 6000]["contaminated"] and got[11, 120]["n_hit"] == 22
        kept = decontaminate.clean(odd, bench, max_broadcast_windows=most)
        assert kept.columns == odd.columns
        assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == [3, 4, 5, 8, 9, 10, 12, 13]
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_items_without_an_id_are_hit_but_not_named(spark):
    bench = spark.createDataFrame([(None, "a b c"), ("7", "b c")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x a b c"), (2, "b c")], "doc_id long, text string")
    for most in (200_000, 1):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in decontaminate.decontaminate(docs, bench, max_broadcast_windows=most).collect()}
        assert got == {1: (3, 1, "7"), 2: (2, 1, "7")}


def test_decontamination_is_by_row_for_any_size_of_benchmark(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(14)))], "item_id int, text string")
    bad = "x " + " ".join(f"b{i}" for i in range(12)) + " y " + " ".join(f"b{i}" for i in range(4, 14))
    docs = spark.createDataFrame([(None, bad), (None, "fine"), (1, bad), (1, "fine too"), (2, None), (3, bad), (3, bad)], "doc_id long, text string")
    for most in (200_000, 1):
        kept = decontaminate.clean(docs, bench, max_broadcast_windows=most)
        assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(None, "fine"), (1, "fine too"), (2, None)]))
        got = decontaminate.decontaminate(docs, bench, max_broadcast_windows=most)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated", "hits"]
        assert [[tuple(h) for h in r["hits"]] for r in got.filter("contaminated").collect()] == [[(1, 13), (14, 24)]] * 4


def test_tokens(spark, odd, none):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())
    want = {(r["doc_id"], r["n_chars"]): lib.encode(r["text"] or "", add_special_tokens=False).ids for r in odd.collect()}
    got = {(r["doc_id"]): r for r in bpe.encode(odd).collect()}
    for (i, _), ids in want.items():
        assert got[i]["ids"] == ids and got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    for r in bpe.encoded_digests(odd).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(got[r["doc_id"]]["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.tokens(none).count() == 0


def test_archives(spark):
    data = [(1, "u", "same"), (2, None, "same"), (2, None, "same"), (3, "v\r\nX: y", ""), (4, "w", None), (None, "n", "same"), (5, "l", "é" * 70_000)]
    df = spark.createDataFrame([(*r, "extra") for r in data], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(df, C.shared_dir(spark), chunk_bytes=1000)
    got = warc.read_archives(manifest, with_data=True, chunk_bytes=999).orderBy("page_id", "chunk_no").toPandas()
    last = got[got["last"]]
    assert len(last) == len(data)
    kinds = {(None if pd.isna(r.page_id) else int(r.page_id)): (r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to)) for r in last.itertuples()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("revisit", 2), 5: ("response", None)}
    long = b"".join(bytes(x) for x in got[got.page_id == 5].data)
    assert long.decode() == "é" * 70_000
    assert last[last.page_id == 5].payload_digest.iloc[0] == base64.b32encode(hashlib.sha1(long).digest()).decode()
    few = warc.read_archives(warc.write_archives(df, C.shared_dir(spark), min_revisit_bytes=5)).filter("record_type = 'revisit'")
    assert few.count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0), C.shared_dir(spark))).count() == 0


def test_surrogates(spark, odd, none):
    out = pii.scrub(odd, b"key").collect()
    by = {(r["doc_id"], r["n_chars"]): r for r in out}
    assert [e["type"] for e in by[13, 16]["entities"]] == ["email", "ip"]
    assert all(r["text"] == s["text"] for r, s in zip(sorted(out, key=str), sorted(pii.scrub(odd, b"key").collect(), key=str), strict=True))
    assert by[3, 0]["text"] is None and by[4, 0]["text"] == ""
    assert pii.scrub(none, b"key").count() == 0


def test_languages(spark, odd, none):
    got = queries.QUERIES["op6_language"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas())
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95 and got.score.between(0, 1).all()
    out = {(r["doc_id"]): r["lang_pred"] for r in language.predict(odd, language.fit(odd)).collect()}
    assert out[3] == out[4] == out[5] == out[12] == "und" and out[0] in ("en", "de")
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(none)).collect()} == {"und"}
    assert language.accepted(odd, language.fit(odd)).filter("doc_id IN (3, 4, 5, 12)").count() == 0


def test_accepted_whatever_the_number_of_languages(spark):
    rng = np.random.default_rng(1)
    known = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for _ in range(100)]
    data, offsets = C.text_buffers(pa.array([" ".join(w) for w in known]))
    grams, own = language._trigrams(data, offsets), np.repeat(np.arange(100), np.diff(offsets))
    counts = np.zeros((100, language.BUCKETS))
    np.add.at(counts, (own[language._LETTER[data]], grams[language._LETTER[data]]), 10_000)
    model = language.Model([f"l{i:03}" for i in range(100)], counts)
    clean = [(i, w[i % 12]) for i, w in enumerate(known)]  # one word of each language
    mixed = [(1000 + i, " ".join(w for k in range(4) for w in known[(i + k) % 100][:6])) for i in range(20)]  # four languages alike
    foreign = [(2000, "это совсем другой язык"), (2001, " ".join("".join(rng.choice(list("qxzjkv"), 7)) for _ in range(30))), (2002, "12 34"), (2003, None)]
    got = language.accepted(spark.createDataFrame(clean + mixed + foreign, "doc_id long, text string"), model)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, _ in clean + mixed]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Every labelled document with a letter is of a known language.
    left = docs.join(language.accepted(docs, language.fit(docs.filter(~language.held_out()))).select("doc_id"), "doc_id", "left_anti")
    assert left.filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").count() == 0


def test_accepted_by_the_selected_mixture(spark, monkeypatch):
    """What accepted() keeps hangs on the mixture that EM and the penalty select: texts for which none is selected go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()))
    data, offsets = C.text_buffers(pa.array(["the children were playing with the dog in the garden", "les enfants jouaient dans le jardin avec le chien"]))
    share, _ = language.mixtures(model, data, offsets)
    own, none = language.evidence(language.gains(model), share, data, offsets), language.evidence(language.gains(model), share[::-1], data, offsets)
    assert (own > none).all() and (share.argmax(axis=1) == [model.languages.index(x) for x in ("en", "fr")]).all()
    monkeypatch.setattr(language, "mixtures", lambda m, data, offsets: (np.zeros((len(offsets) - 1, len(m.languages))), np.zeros(len(offsets) - 1, np.int64)))
    part = pa.RecordBatch.from_pydict({"text": ["the children were playing"]})
    assert not language._mixed(part, "text", model)[4].any()


def near_truth(pairs):
    sets = {}
    for i, t in pairs:
        w = words(t, True)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    truth = near_truth([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None])
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == truth[r["doc_id"]]
    kept = neardup.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted(i for i, (_, c) in truth.items() if i == c)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_large_family(spark):
    """Copies that were edited apart: many pairs lie on either side of the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(90)]
    data = []
    for i in range(70):
        w = list(base)
        for p in rng.choice(90, rng.integers(0, 7), replace=False):
            w[p] = f"e{i}x{p}"
        data.append((int(rng.integers(0, 10**6)), " ".join(w)))
    data = list({i: t for i, t in data}.items())
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == near_truth(data)


def test_rows_that_repeat_an_id_tie_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    data = [(5, a), (5, b), (7, near(a)), (9, near(b)), (11, near(b)), (12, "alone in the whole wide world"), (3, near(a) + " end"), (20, None), (20, "one two")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i: c for (i, _), c in got.items()} == {5: 3, 7: 3, 9: 3, 11: 3, 12: 12, 3: 3, 20: 20}
    kept = neardup.without_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 12, 20]


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Blocks and set blocks of a few documents: every pair is still met."""
    monkeypatch.setattr(neardup, "PAIR_BLOCK", 7)
    monkeypatch.setattr(neardup, "SET_BLOCK", 400)
    monkeypatch.setattr(neardup, "STAR_CHUNKS", 0)
    rng = np.random.default_rng(3)
    base, data = [f"w{i}" for i in range(90)], []
    for i in range(60):
        w = list(base)
        for p in rng.choice(90, rng.integers(0, 9), replace=False):
            w[p] = f"e{i % 9}x{p}"
        data.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == near_truth(data)


def test_token_files(spark, odd, none):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = sstable.read_shards(sstable.write_shards(docs, C.shared_dir(spark))).orderBy("id").collect()
    start = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*lib.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sstable.read_shards(sstable.write_shards(odd, C.shared_dir(spark))).count() == odd.count()
    assert sstable.read_shards(sstable.write_shards(none, C.shared_dir(spark))).count() == 0


def test_fingerprints(spark, odd, none):
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    order = [(r["doc_id"], r["text"] or "") for r in docs.orderBy(F.desc("doc_id")).collect()]
    want = {}
    for k, (i, t) in enumerate(order):
        e = fingerprint.edited(t, order[(k + 1) % len(order)][1])
        want[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.to_text(fingerprint.sketch(fingerprint.shingle_hashes(e.encode()))))
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["edited_fingerprint"]) for r in fingerprint.neighbours(docs).collect()}
    assert got == want
    few = spark.createDataFrame([(1, "abc" * 20), (2, "defg" * 20), (3, "hij" * 20), (None, "nul" * 30)], "doc_id long, text string")
    by = {r["doc_id"]: r for r in fingerprint.neighbours(few).collect()}
    for i, nxt in ((3, "defg" * 20), (2, "abc" * 20), (1, "nul" * 30), (None, "hij" * 20)):
        own = {1: "abc" * 20, 2: "defg" * 20, 3: "hij" * 20, None: "nul" * 30}[i]
        e = fingerprint.edited(own, nxt)
        s, es, ns = (fingerprint.sketch(fingerprint.shingle_hashes(t.encode())) for t in (own, e, nxt))
        assert by[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and by[i]["fingerprint"] == fingerprint.to_text(s)
        assert by[i]["near_edited"] == fingerprint.resemblance(s, es, fingerprint.K) and by[i]["near_next"] == fingerprint.resemblance(s, ns, fingerprint.K)
    assert fingerprint.neighbours(odd).count() == odd.count() and fingerprint.neighbours(none).count() == 0
    one = fingerprint.neighbours(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    prints = fingerprint.fingerprints(odd).collect()
    assert len({r["fingerprint"] for r in prints if r["doc_id"] in (0, 2, None)}) == 1


def test_toxicity(spark, odd, none):
    got = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas())
    held = got[got.held_out]
    rank = held.score.rank()
    n1 = held.toxic.sum()
    assert (rank[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(held) - n1)) > 0.9
    labels = spark.createDataFrame([(0, 1), (1, None), (6, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(odd, toxicity.fit(none, labels.limit(0))).count() == odd.count()


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = p.run(spark, SF).toPandas()
    # By brute force: languages as the operator finds them, then links, benchmark windows, surrogates, tokens.
    known = {r["doc_id"] for r in language.accepted(spark.read.parquet(f"{SF}/documents.parquet"), language.fit(spark.read.parquet(f"{SF}/documents.parquet").filter(~language.held_out()))).collect()}
    left = docs[docs.doc_id.isin(known)]
    comp = near_truth(list(zip(left.doc_id, left.text, strict=True)))
    left = left[[comp[i][1] == i for i in left.doc_id]]
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(pat, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text:
        w = low(t)
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)}
    left = left[[not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)) for w in map(low, left.text)]]
    assert sorted(got.doc_id) == sorted(left.doc_id)
    made, e = pii.Surrogates(pii.QUERY_KEY), bpe.encoder(bpe.default_vocabulary())
    texts = [pii.scrub_text(t, made)[0] for t in left.text]
    ids, bounds = e.encode([e.chunks(t) for t in texts])
    want = {i: ids[bounds[k] : bounds[k + 1]].tolist() for k, i in enumerate(left.doc_id)}
    assert {r.doc_id: list(r.ids) for r in got.itertuples()} == want


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    for name, f in p.STAGES[:-1]:
        assert f(spark, none, SF).count() == 0 and f(spark, none, SF).columns == none.columns
    assert stages["bpe"](spark, none, SF).count() == 0
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: -1 if i is None else i)
    all_ids = ids(odd)
    known = stages["language"](spark, odd, SF)
    assert known.columns == odd.columns and not {3, 4, 5, 12} & set(ids(known)) and {0, 8} <= set(ids(known))
    once = stages["near_duplicates"](spark, odd, SF)
    assert once.columns == odd.columns and ids(once) == [None, 0, 3, 4, 5, 6, 8, 10, 12, 13]
    assert ids(stages["decontamination"](spark, odd, SF)) == all_ids
    clean = {(r["doc_id"], r["row"]): r for r in stages["pii"](spark, odd, SF).collect()}
    assert len(clean) == len({(r["doc_id"], r["row"]) for r in odd.collect()}) and clean[3, 3]["text"] is None and clean[13, 13]["text"] != "a@b.org 10.0.0.1"
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean.values())
    coded = stages["bpe"](spark, odd, SF).collect()
    assert len(coded) == len(all_ids) and {len(r["ids"]) for r in coded if r["doc_id"] in (3, 4, 5)} == {0}


INTERNAL = ("_gone", "_least", "_id", "_hash", "_row", "hash", "gone", "least", "of", "held", "row", "component_id", "n_shingles", "contaminated", "dw", "win", "token", "n", "sig", "label", "a", "b")


@pytest.mark.parametrize("bounded", [True, False])
def test_stages_keep_columns_of_any_name(spark, bounded):
    """Columns named like anything inside the operators come back as they were, repeated ids and large benchmarks included."""
    base = " ".join(f"word{i}" for i in range(40))
    texts = [base, base + " more", "quite another text of some ten or so words here now", None, ""]
    data = [(i, t, *["mine"] * len(INTERNAL)) for i, t in enumerate(texts)] + [(1, "twice the same id", *["mine"] * len(INTERNAL))]
    docs = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in INTERNAL))
    bench = spark.createDataFrame([(7, "another text of some ten or so words here"), (8, None)], "item_id long, text string")
    kept = neardup.without_copies(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 2 AND text IS NOT NULL").count() == 1
    clean = decontaminate.clean(docs, bench, window=8, max_broadcast_windows=10**6 if bounded else 0)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1
    for out in (kept, clean):
        assert all(r[c] == "mine" for r in out.collect() for c in INTERNAL)


def test_toxicity_of_repeated_rows(spark):
    """Ids with many rows weigh like any other: many rows an id and one row an id teach alike."""
    texts = [("you are an idiot and a fool", 1), ("the weather is mild and fine today", 0)]
    few = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts * 30) for _ in range(30)], "doc_id long, text string")
    once = few.dropDuplicates()
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts * 30)], "doc_id long, toxic int")
    two = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts) for _ in range(30)], "doc_id long, text string")
    scores = []
    for docs in (few, once):
        model = toxicity.fit(docs, labels)
        got = {r["doc_id"]: r["score"] for r in toxicity.score(once, model).collect()}
        scores.append(got)
        assert all(got[i] > 0.9 if i % 2 == 0 else got[i] < 0.1 for i in got)
    assert scores[0] == pytest.approx(scores[1])
    toxicity.fit(two, labels.limit(2))  # two labelled texts teach little, and don't fail


def test_toxicity_against_a_plain_fit(spark):
    """Scores of a small table order as those of a logistic model fitted by plain gradient steps on the words."""
    rng = np.random.default_rng(2)
    vocab = ["sun", "rain", "idiot", "stupid", "lovely", "kind", "vile", "tree"]
    bad = np.array([0, 0, 1, 1, 0, 0, 1, 0])
    docs, y = [], []
    for i in range(300):
        w = rng.choice(8, 6)
        docs.append((i, " ".join(vocab[k] for k in w)))
        y.append(int(bad[w].sum() >= 2))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    x = np.array([[float(v in t.split()) for v in vocab] for _, t in docs])
    w, b = np.zeros(8), 0.0
    for _ in range(3000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - np.array(y)
        w, b = w - 0.5 * x.T @ e / 300, b - 0.5 * e.mean()
    plain = 1 / (1 + np.exp(-(x @ w + b)))
    ours = np.array([got[i] for i in range(300)])
    assert np.corrcoef(plain, ours)[0, 1] > 0.97
    assert ((plain >= 0.5) == (ours >= 0.5)).mean() > 0.97


def test_fingerprints_against_sets_of_shingles(spark):
    """Estimates of whole texts against exact sets of shingles, and edits against plain slicing; nothing of the operator is used."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id", ascending=False)
    texts = [t or "" for t in docs["text"]]
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_fingerprint"](spark, SF).collect()}
    shingles = lambda t: {t.encode()[i : i + 12] for i in range(max(len(t.encode()) - 11, 1))} if t else set()
    off = {"near_edited": [], "near_next": [], "in_edited": [], "n_distinct": []}
    for k, (i, t) in enumerate(zip(docs["doc_id"], texts, strict=True)):
        after = texts[(k + 1) % len(texts)]
        cut = len(t) // 3
        e = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = shingles(t), shingles(e), shingles(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        off["near_edited"].append(r["near_edited"] - like(a, b))
        off["near_next"].append(r["near_next"] - like(a, c))
        if a:
            off["in_edited"].append(r["in_edited"] - len(a & b) / len(a))
            off["n_distinct"].append(r["n_distinct"] / len(a) - 1)
    for name, x in off.items():  # 128 hashes tell a share to some 0.045, without a lean to a side
        assert np.abs(x).max() < 0.25 and np.std(x) < (0.13 if name == "n_distinct" else 0.06) and abs(np.mean(x)) < 0.02, name
    same = {}
    for i, t in zip(docs["doc_id"], texts, strict=True):
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_scrubbing_against_plain_rules(spark):
    """What op5 leaves of texts made of known entities: they are gone everywhere, everything else stays, and one entity has one surrogate of its form."""
    rng = np.random.default_rng(7)
    names, mails = ["Zorba", "Quentin", "Tamsin", "Wendel"], ["ann.lee@mail.org", "bo_9@x.co", "c-d@sub.host.net"]
    phones, ips = ["+44 20 7946 0958", "+1 (555) 123-4567", "+49 170 1234567"], ["10.1.2.3", "8.8.4.4", "192.168.7.9"]
    frames = ["Please write to {m} about it.", "Mr {n} called from {p} today.", "The host {i} was down; {m} knows.", "Nothing to see in 1984 or on page 12.", "Dr {n} wrote twice."]
    data = []
    for k in range(150):
        pick = {"n": str(rng.choice(names)), "m": str(rng.choice(mails)), "p": str(rng.choice(phones)), "i": str(rng.choice(ips))}
        data.append((k, "\n".join(str(rng.choice(frames)) for _ in range(4)), pick))
    docs = spark.createDataFrame([(k, t.format(**pick)) for k, t, pick in data], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.scrub(docs, b"some key").collect()}
    seen = {}
    for k, frame, pick in data:
        pattern = "".join(f"(?P<{x[1]}_{j}>.+?)" if len(x) == 3 and x[0] == "{" else re.escape(x) for j, x in enumerate(re.split(r"(\{.\})", frame)))
        m = re.fullmatch(pattern, got[k], re.S)
        assert m, got[k]  # all but the entities is as it was
        for place, new in m.groupdict().items():
            old = pick[place[0]]
            assert new != old and seen.setdefault((place[0], old), new) == new
            shape = lambda v: re.sub(r"[^\W\d_]", "a", re.sub(r"\d+" if place[0] == "i" else r"\d", "0", v))  # noqa: B023, E731
            assert shape(new) == shape(old)
    assert len(set(seen.values())) == len(seen)
