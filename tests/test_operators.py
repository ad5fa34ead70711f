"""Operators on small frames, against pandas and NumPy or by their invariants."""

import datetime as dt
import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweft.functions import exprs as X
from panelweft.functions import stats as S
from panelweft.operators import changes, econometrics, knowledge, mentions, panel, spatial, survey, text, verify
from panelweft.plans import tracks
from panelweft.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_coercions(spark):
    df = frame(spark, [("12",), ("12d",), ("NaN",), (" 1e3 ",), (None,), ("-.5",)], "x string")
    assert [r[0] for r in df.select(X.to_number("x")).collect()] == [12.0, None, None, 1000.0, None, -0.5]
    df = frame(spark, [("2014-15",), ("x2014",), (None,)], "x string")
    assert [r[0] for r in df.select(X.year_of_period("x")).collect()] == [2014, None, None]


def test_row_means(spark):
    df = frame(spark, [(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    got = df.select(X.row_mean(["a", "b", "c"]).alias("m"), X.row_count(["a", "b", "c"]).alias("n"), X.weighted_mean(["a", "b", "c"], [1, 1, 3]).alias("w")).collect()
    assert [tuple(r) for r in got] == [(2.0, 2, 2.5), (None, 0, None)]


def test_zscore_of_a_constant_is_zero(spark):
    df = frame(spark, [(5.0,), (5.0,), (None,)], "v double")
    assert {r["z"] for r in S.winsor_zscore(df, "v", "z").collect()} == {0.0}


def test_zscore_matches_pandas(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=200)
    s = pd.Series(v).clip(np.quantile(v, 0.05), np.quantile(v, 0.95))
    got = S.winsor_zscore(frame(spark, [(float(x),) for x in v], "v double"), "v", "z").orderBy("v").toPandas()["z"]
    assert np.allclose(got, np.sort((s - s.mean()) / s.std()))


def test_correlation_of_a_constant_is_null(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(S.correlation("x", "y")).first()[0] is None


def test_vif(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=50), rng.normal(size=50)
    df = frame(spark, [(float(x), float(y), float(x + y)) for x, y in zip(a, b, strict=True)], "a double, b double, c double")
    assert all(v == float("inf") for v in S.vif(df, ["a", "b", "c"]).values())
    two = S.vif(df, ["a", "b"])
    assert two["a"] == pytest.approx(1 / (1 - np.corrcoef(a, b)[0, 1] ** 2))


def test_interpolation_is_by_row(spark):
    df = frame(spark, [("s", 2014, 1.0), ("s", 2015, None), ("s", 2019, 9.0), ("t", 2014, None), ("t", 2015, 4.0)], "e string, y int, v double")
    got = {(r["e"], r["y"]): r["v"] for r in panel.interpolate(df, ["v"], "e", "y").collect()}
    assert got == {("s", 2014): 1.0, ("s", 2015): 5.0, ("s", 2019): 9.0, ("t", 2014): 4.0, ("t", 2015): 4.0}


def test_nearest_takes_the_earlier_of_two(spark):
    left = frame(spark, [(2015,), (2020,), (None,), (1990,)], "year int")
    right = frame(spark, [(2014, 1.0), (2016, 2.0), (2018, 3.0)], "year int, v double")
    got = {r["year"]: r["v"] for r in panel.nearest(left, right, "year", ["v"]).collect()}
    assert got == {2015: 1.0, 2020: 3.0, None: None, 1990: 1.0}


def test_nearest_of_nothing(spark):
    left = frame(spark, [(2015,)], "year int")
    assert panel.nearest(left, frame(spark, [], "year int, v double"), "year", ["v"]).collect()[0]["v"] is None


def test_sums_of_nulls_are_zero(spark):
    df = frame(spark, [("a", None), ("a", None)], "k string, v double")
    assert panel.group_sum(df, ["k"], ["v"]).collect()[0]["v"] == 0.0


def test_two_way_demeaning(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, [(f"e{i}", t, float(rng.normal())) for i in range(6) for t in range(5)], "e string, t int, v double")
    for f in (panel.demean, panel.demean_iterated):
        out = f(df, ["v"], "e", "t").toPandas()
        assert np.allclose(out.groupby("e").v.mean(), 0, atol=1e-9) and np.allclose(out.groupby("t").v.mean(), 0, atol=1e-9)


def test_ols_against_dummies(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        for t in range(8):
            if (i + t) % 7:
                x = rng.normal()
                rows.append((f"e{i:02}", t, float(2 * x + i - t + rng.normal() / 10), float(x)))
    df = frame(spark, rows, "e string, t int, y double, x double")
    p = pd.DataFrame(rows, columns=["e", "t", "y", "x"])
    d = np.column_stack([p.x, pd.get_dummies(p.e), pd.get_dummies(p.t).iloc[:, 1:]]).astype(float)
    want = np.linalg.lstsq(d, p.y, rcond=None)[0][0]
    fit = econometrics.ols(df, "y", ["x"], "e", "t", exact=True)
    assert fit.coef[0] == pytest.approx(want, abs=1e-7)
    assert fit.n == len(rows) and fit.se[0] > 0 and fit.p[0] < 1e-6


def test_ols_tolerates_a_constant_regressor(spark):
    df = frame(spark, [(f"e{i}", t, float(i * t % 5), float(i + t * t), 1.0) for i in range(5) for t in range(5)], "e string, t int, y double, x double, c double")
    fit = econometrics.ols(df, "y", ["x", "c"], "e", "t")
    assert fit.coef[1] == pytest.approx(0) and fit.t[1] is None or abs(fit.coef[1]) < 1e-9


def test_ols_needs_rows(spark):
    with pytest.raises(ValueError):
        econometrics.ols(frame(spark, [("a", 1, 1.0, 1.0)], "e string, t int, y double, x double"), "y", ["x"], "e", "t")


def test_placebo_keeps_each_times_values(spark):
    df = frame(spark, [(f"e{i}", t, float(i * 10 + t) if i else None) for i in range(5) for t in range(3)], "e string, t int, v double")
    out = econometrics.placebo(df, ["v"], "e", "t", 7).toPandas()
    for t, g in df.toPandas().groupby("t"):
        assert sorted(g.v.fillna(-1)) == sorted(out[out.t == t].v.fillna(-1))


def test_rank_stability_of_one_domain_never_moves(spark):
    df = frame(spark, [(f"e{i}", 1, float(i), 1.0) for i in range(5)], "e string, t int, a double, b double")
    assert {r["sd_rank"] for r in econometrics.rank_stability(df, ["a", "b"], "e", "t", draws=20).collect()} == {0.0}


def test_weights_are_a_distribution(spark):
    w = econometrics.weight_draws(frame(spark, [(1,), (2,)], "t int"), "t", ["a", "b", "c"], 400, 1).toPandas()
    assert np.allclose(w[["w_a", "w_b", "w_c"]].sum(axis=1), 1) and abs(w.w_a.mean() - 1 / 3) < 0.03


def test_eligibility_priority(spark):
    rows = [(1, "p", "yes", "false", "x", "300"), (2, "p", "yes", "false", "x", "300"), (3, "q", "no", "true", "", "1"), (4, "q", "1", "true", "", "1"), (5, "r", "yes", "1", "", "1"), (6, "s", "yes", "0", "", "1"), (7, "t", "yes", "0", "x", "1"), (8, "", "yes", "0", "x", "0"), (9, None, "yes", "0", "x", None)]
    df = frame(spark, rows, "response_id int, phone string, consent string, breakoff_flag string, country string, interview_duration_sec string")
    got = {r["response_id"]: r["reason"] for r in survey.with_eligibility(df, order="response_id", required=("consent", "country")).collect()}
    assert got == {1: "eligible_full_completion", 2: "duplicate_response", 3: "consent_not_granted", 4: "duplicate_response", 5: "breakoff_detected", 6: "missing_required_fields", 7: "duration_outlier", 8: "eligible_full_completion", 9: "eligible_full_completion"}


def test_state_machine(spark):
    state = frame(spark, [("a", "ready", 0), ("b", "awaiting_reply", 1), ("c", "awaiting_reply", 0), ("d", "completed", 2)], "k string, status string, step int")
    replies = frame(spark, [("b", "yes"), ("c", " "), ("d", "x"), ("e", "y")], "k string, reply string")
    got = {r["k"]: (r["status"], r["step"]) for r in survey.advance(state, replies, key="k", n_questions=2).collect()}
    assert got == {"a": ("awaiting_reply", 0), "b": ("completed", 2), "c": ("awaiting_reply", 0), "d": ("completed", 2), "e": ("awaiting_reply", 0)}


def test_articles(spark):
    kw = text.keyword_index({"A": {"en": ["net", " "], "fr": ["net"]}, "B": {"en": ["bank"]}})
    df = frame(spark, [(1, "The NET", "bank"), (2, None, None), (3, "bank", "")], "id int, title string, summary string")
    got = {r["id"]: (r["primary_domain"], r["secondary_domains"], r["confidence"]) for r in text.map_articles(df, kw).collect()}
    assert got == {1: ("A", ["B"], 0.6667), 2: ("UNMAPPED", [], 0.0), 3: ("B", [], 1.0)}


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    sets = [sorted({f"t{x}" for x in rng.integers(0, 12, rng.integers(1, 10))}) for _ in range(60)]
    df = frame(spark, list(enumerate(sets)), "id int, k array<string>")
    rep = {}
    for i, s in enumerate(sets):
        rep.setdefault(tuple(s), i)
    want = {(rep[tuple(s)], i) for i, s in enumerate(sets) if rep[tuple(s)] != i}
    reps = sorted(rep.values())
    want |= {(a, b) for a in reps for b in reps if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert {(r["a"], r["b"]) for r in text.jaccard_pairs(df, "id", "k", 0.6).collect()} == want


def test_links(spark):
    df = frame(spark, [("A", "see [[B]] and [[C|label]] **Trust** ## x"), ("B", "[[a]] [[C]]"), ("D", "none")], "title string, body string").withColumn("links", X.wikilinks("body"))
    assert sorted(r["dst"] for r in text.broken_links(df, "title", "links").collect()) == ["C", "C", "a"]  # as written
    assert {r["title"] for r in text.orphans(df, "title", "links").collect()} == {"A", "D"}
    one = text.kb_stats(df, "title", "body", "links").first()
    assert (one["n_docs"], one["n_without_links"], one["n_broken"]) == (3, 1, 2)


def test_many_keywords_are_an_automaton(spark):
    """The same as the expressions, for keywords inside others, of several languages and with quotes; and 50,000 in a plan of fixed size."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list('ab "é語'), n))
    config = {d: {lang: [word(rng.integers(1, 4)) for _ in range(12)] for lang in ("en", "fr", "ja")} for d in ("ACC", "ECO", "OUT")}
    keywords = text.keyword_index(config)
    df = frame(spark, [(i, word(rng.integers(0, 30)), None if i % 5 == 0 else word(rng.integers(0, 60)), "x") for i in range(60)] + [(99, None, "", "x")], "id int, title string, summary string, _row string")
    one, two = (sorted(map(repr, text.map_articles(df, keywords, few=few).collect())) for few in (10**6, 0))
    assert one == two
    many = [("D%d" % (i % 6), f"l{i % 10}", f"key{i} word") for i in range(50_000)] + [("D1", "en", "zebra")]
    out = text.map_articles(frame(spark, [(1, "a KEY77 word and key778  word", "zebra")], "id int, title string, summary string"), many)
    row = out.first()
    assert (row["score_D5"], row["score_D4"], row["score_D1"], row["primary_domain"]) == (1, 1, 1, "D1")
    assert len(out._jdf.queryExecution().toString()) < 50_000
    with pytest.raises(ValueError):
        text.map_articles(df, [("A", "en", "x" * (1 << 26) + "y")] * 65)


def contained(data):
    return {(a, b) for a, own, body in data for b, title, _ in data if title and own != title and title.lower() in (body or "").lower()}


def test_backlinks_are_containment(spark):
    """As `in` finds them: inside words, with punctuation, of any length and script, nulls and empty ones aside."""
    long = "Open Data Plan from a State Data Portal (Granular Regional Coverage)"
    data = [(1, long, f"own {long}"), (2, "Short", f"See {long.upper()}, then."), (3, "Other", "shortest"), (4, "C++ (a?)", "short other's"), (5, "ort", "uses c++ (A?) here"), (6, long, f"x {long} y"), (7, "é", "CAFÉS"), (8, "Z", None), (9, None, "other z"), (10, "", "é"), (11, "日本", "この日本語"), (12, "e", "short"), (13, "x" * 300, "y" + "X" * 301)]
    df = frame(spark, data, "id long, title string, text string")
    got = text.backlinks(df, "id", "title", "text").collect()
    assert {(r["src"], r["dst"]) for r in got} == contained(data) and len(got) == len(contained(data))
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("ab .É"), n))
    data = [(i, word(rng.integers(1, 9)), word(rng.integers(0, 60))) for i in range(120)]
    df = frame(spark, data, "id long, title string, text string")
    for gram in (3, 10):
        pairs = mentions.containing(df.select("id", F.lower("text").alias("text")), df.select(F.lower("title").alias("needle")), gram=gram).collect()
        assert {(r["id"], r["needle"]) for r in pairs} == {(i, t.lower()) for i, _, x in data for _, t, _ in data if t.lower() in x.lower()}
        assert len(pairs) == len({tuple(r) for r in pairs})
    assert mentions.containing(df, df.select(F.lit("").alias("needle"))).count() == 0


def test_lint_follows_the_rules(spark):
    """One article alone is out of balance only where the mean is over 3; a big folder only above four times the mean and 10."""
    paths = [f"big/{i}.md" for i in range(60)] + [f"{c}/{i}.md" for c in "abcdefgh" for i in range(2)] + ["solo/x/1.md", "top.md"]
    docs = knowledge.articles(frame(spark, [(p, f"# {p}\n") for p in paths], "path string, content string"))
    assert {(r["folder"], r["n"]) for r in knowledge.unbalanced(docs).collect()} == {("big", 60), ("solo", 1), ("root", 1)}
    assert knowledge.unbalanced(docs.filter("path LIKE 'big/%'")).count() == 0
    twins = knowledge.articles(frame(spark, [("a.md", "# A\n\nthe same old words again"), ("b.md", "# A\n\nthe same old words, again!"), ("c.md", "# C\n\nnothing alike")], "path string, content string"))
    found = {(r["check"], r["item"], r["detail"]) for r in knowledge.lint(twins).collect()}
    assert ("duplicate_content", "a.md", "b.md") in found and sum(c == "duplicate_content" for c, *_ in found) == 1


def test_feed(spark):
    rss = "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><description>&lt;p&gt;hi&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title></title></item></channel></rss>"
    atom = '<feed xmlns="a"><entry><title>T</title><link rel="self" href="http://s"/><link href="http://y/2"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    got = {r["source_id"]: r for r in readers.feed_entries(frame(spark, [("r", rss), ("a", atom)], "source_id string, value string")).collect()}
    assert got["r"]["title"] == "A & B" and got["r"]["summary"] == "hi" and got["r"]["published_at"].hour == 3
    assert got["a"]["url"] == "http://y/2" and got["a"]["published_at"] is not None


def test_payloads(spark):
    page = json.dumps([{"page": 1}, [{"indicator": {"id": "I", "value": "N"}, "country": {"id": "IN", "value": "India"}, "countryiso3code": "IND", "date": "2020", "value": 1.5}, {"countryiso3code": "", "date": "2020"}]])
    got = readers.indicator_payloads(frame(spark, [(page,), ('[{"message": []}]',)], "value string")).collect()
    assert [(r["iso3c"], r["year"], r["value"]) for r in got] == [("IND", 2020, 1.5)]


def test_utm_of_the_meridian(spark):
    e, n = spatial.utm(F.lit(26.0), F.lit(87.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r["e"] == pytest.approx(500000, abs=1e-3) and r["n"] == pytest.approx(2875637, abs=400)


def test_nearest_place_ties_go_to_the_least_name(spark):
    got = spatial.nearest_place(frame(spark, [(0.0, 0.0)], "x double, y double"), frame(spark, [("b", 1.0, 0.0), ("a", -1.0, 0.0)], "p string, px double, py double"), x="x", y="y", place="p", px="px", py="py").first()
    assert (got["p"], got["distance"]) == ("a", 1.0)


def test_verify_and_audit(spark):
    df = frame(spark, [("a", 2014, 150.0), ("a", 2014, None)], "e string, y int, fem_literacy double")
    r = verify.verify(df, "d", required=["e", "fem_literacy"], key=["e", "y"], time="y", entity="e", years=(2010, 2020), numeric=["fem_literacy"])
    assert {i["check"] for i in r.issues} == {"nulls_fem_literacy", "range_fem_literacy", "duplicates"} and r.has_errors
    assert verify.verify(df, "d", required=["zz"]).has_errors
    a = verify.Audit("p", {"x": 1})
    a.record_stage("s", 3, 1, 1)
    assert {i["check"] for i in verify.check_manifest(a.complete()).issues} == {"accounting", "git_commit"}
    assert verify.check_manifest("{").has_errors


def _xxhash64(data, seed):
    """XXH64 of under 32 bytes."""
    m, p1, p2, p3, p4, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    rot = lambda x, r: (x << r | x >> (64 - r)) & m
    h, at = (seed + p5 + len(data)) & m, 0
    for at in range(0, len(data) - 7, 8):
        h ^= rot(int.from_bytes(data[at : at + 8], "little") * p2 & m, 31) * p1 & m
        h = (rot(h, 27) * p1 + p4) & m
    at = len(data) // 8 * 8
    if len(data) - at >= 4:
        h ^= int.from_bytes(data[at : at + 4], "little") * p1 & m
        h, at = (rot(h, 23) * p2 + p3) & m, at + 4
    for b in data[at:]:
        h = rot(h ^ b * p5 & m, 11) * p1 & m
    h = (h ^ h >> 33) * p2 & m
    h = (h ^ h >> 29) * p3 & m
    return h ^ h >> 32


def test_fingerprint_by_brute_force(spark):
    from panelweft.plans import queries as library

    assert library.QUERIES["fingerprint_digests"](spark, "/root/testdata/sf0.001").columns == ["n_rows", "xor", "total"]
    data = [(1, "a"), (2, None), (None, "twelve bytes"), (1, "a"), (77, "")]
    hashes = []
    for row in data:
        h = 42
        for v in row:
            h = _xxhash64(("\0" if v is None else str(v)).encode(), h)
        hashes.append(h - (1 << 64) * (h >> 63))
    xor = 0
    for h in hashes:
        xor ^= h
    got = changes.fingerprint(frame(spark, data, "i int, s string"), ["i", "s"]).first()
    assert (got["n_rows"], got["xor"], int(got["total"])) == (5, xor, sum(hashes))


def test_fingerprint_is_independent_of_order(spark):
    a = frame(spark, [(1, "x"), (2, None)], "i int, s string")
    b = frame(spark, [(2, None), (1, "x")], "i int, s string")
    assert changes.fingerprint(a, ["i", "s"]).first() == changes.fingerprint(b, ["i", "s"]).first()
    assert changes.small_fingerprint(a, ["i", "s"]) == changes.small_fingerprint(b, ["i", "s"])
    assert changes.should_rebuild(None, {})[0]


def test_state_track(spark):
    raw = frame(spark, [(" S1 ", "2014-15", "120"), ("S1", "2015", "50"), ("S2", "2014", "x"), (None, "2014", "1"), ("S2", "2016", "70")], "state_name string, year string, pop_hh_elec string")
    a = tracks.survey_means(raw, {"pop_hh_elec": "ACC_pop_hh_elec"})
    b = tracks.survey_means(raw.withColumnRenamed("pop_hh_elec", "fem_literacy"), {"fem_literacy": "SKL_fem_literacy"})
    nat = tracks.national_sums(frame(spark, [("2014-01", "1"), ("2015-02", None)], "month string, total_vol string"), {"total_vol": "NAT_upi_total_vol"})
    shg = tracks.group_totals(frame(spark, [("S1", "5"), ("S2", "7")], "State string, Members string"), "State", None, {"Members": "AGR_shg_member_scale"})
    out = tracks.state_year(a, b, {"upi": nat}, shg).toPandas()
    assert len(out) == 4 and out.composite_score.notna().all() and set(out.AGR_shg_member_scale) == {5.0, 7.0}


def test_country_and_api_tracks(spark):
    rng = np.random.default_rng(6)
    rows = [(f"{k}{j}", f"{k} {j}", "x", f"E{e}", y, float(rng.normal()), "0", "Yes") for k in ("skill", "internet", "trade") for j in range(3) for e in range(6) for y in range(2014, 2020)]
    long = frame(spark, rows, "indicator_code string, indicator_name string, pillar string, economy string, year int, norm_score double, was_imputed string, include_v2 string")
    mapping = long.select("indicator_code", "indicator_name", "pillar").distinct()
    observed = mapping.select("indicator_code", F.lit(90.0).alias("pct_observed"))
    out, intake, chosen = tracks.country_year(long, mapping, observed)
    got = out.toPandas()
    assert len(got) == 36 and set(chosen) == {"SKL", "ACC", "ECO"} and set(got.model_trust_tier) == {"Medium"}
    api = frame(spark, [(c, c[:3].upper(), "negative" if j else "positive", e, y, v) for j, (c, _, _, e, y, v, _, _) in enumerate(rows)], "indicator_code string, domain string, direction string, iso3c string, year int, value double").replace({"SKI": "SKL", "INT": "ACC", "TRA": "ECO"}, subset=["domain"])
    scored = tracks.api_year(api, frame(spark, [("E1", "One")], "iso3c string, country_name string")).toPandas()
    assert len(scored) == 6 and scored.composite_score.notna().all()


def test_places_by_leaves_are_those_of_the_scan(spark):
    import random

    rng = random.Random(4)
    places = [(f"p{i:03}", rng.gauss(0, 1) ** 3, rng.gauss(0, 5)) for i in range(300)] + [("same", 50.0, 50.0), ("a_same", 50.0, 50.0)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(200)] + [(900, None, 1.0), (901, 50.0, 51.0)]
    args = dict(x="x", y="y", place="p", px="px", py="py")
    df, to = frame(spark, points, "id int, x double, y double"), frame(spark, places, "p string, px double, py double")
    scan = {r["id"]: (r["p"], r["distance"]) for r in spatial.nearest_place(df.filter("x IS NOT NULL"), to, **args).collect()}
    for leaf in (1, 16):
        leaves = {r["id"]: (r["p"], r["distance"]) for r in spatial.nearest_place(df, to, few=10, leaf=leaf, **args).collect()}
        assert leaves.pop(900) == (None, None) and leaves[901][0] == "a_same"
        assert {i: (p, round(d, 9)) for i, (p, d) in leaves.items()} == {i: (p, round(d, 9)) for i, (p, d) in scan.items()}


def test_crowded_places_fill_no_leaf(spark):
    """99 of 100 places within a millionth of the rest's extent: leaves keep their bound, and the result is the scan's."""
    rng = np.random.default_rng(3)
    crowd = rng.normal(0, 1e-4, (1980, 2))
    spots = np.concatenate([crowd, rng.uniform(-500, 500, (20, 2)), np.tile([[7.0, 7.0]], (3, 1)), np.stack([np.zeros(50), rng.integers(0, 9, 50) * 1e-7], axis=1)])
    places = [(f"p{i:04}", float(a), float(b)) for i, (a, b) in enumerate(spots)]
    to = frame(spark, places, "p string, px double, py double")
    tree, bound = spatial.partitioned(to.groupBy(F.col("px").alias("_px"), F.col("py").alias("_py")).count(), leaf=20, sample=100)
    distinct = np.unique(spots, axis=0)
    sizes = np.bincount(tree.of(distinct[:, 0], distinct[:, 1]), minlength=tree.n)
    assert bound == 20 and sizes.max() <= 20 and sizes.min() > 0
    asked = np.concatenate([rng.normal(0, 1e-4, (80, 2)), rng.uniform(-600, 600, (60, 2)), [[1e6, -1e6], [7.0, 7.0]]])
    df = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(asked)], "id int, x double, y double")
    got = {r["id"]: (r["p"], r["distance"]) for r in spatial.nearest_place(df, to, x="x", y="y", place="p", px="px", py="py", few=10, leaf=20).collect()}
    for i, (a, b) in enumerate(asked):
        d = np.sqrt((spots[:, 0] - a) ** 2 + (spots[:, 1] - b) ** 2)
        assert got[i][1] == pytest.approx(d.min(), rel=1e-12) and d[int(got[i][0][1:])] == pytest.approx(d.min(), rel=1e-12)
    assert got[len(asked) - 1][0] == "p2000"


def test_constant_and_effects_equal_dummies(spark):
    import numpy as np

    from panelweft.operators import econometrics

    rng = np.random.default_rng(2)
    rows = [(f"e{e}", t, float(rng.normal()), 0.0) for e in range(8) for t in range(6) if (e + t) % 7]
    rows = [(e, t, x, 2 * x + int(e[1:]) - t + float(rng.normal()) / 10) for e, t, x, _ in rows]
    fit, constant = econometrics.ols_with_constant(frame(spark, rows, "e string, t int, x double, y double"), "y", ["x"], "e", "t")
    es, ts = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    d = np.array([[r[2], *(float(r[0] == e) for e in es), *(float(r[1] == t) for t in ts)] for r in rows])
    b = np.linalg.lstsq(d, np.array([r[3] for r in rows]), rcond=None)[0]
    assert abs(fit.coef[0] - b[0]) < 1e-7
    assert abs(constant - (np.mean([r[3] for r in rows]) - b[0] * np.mean([r[2] for r in rows]))) < 1e-6


def test_files_are_hashed_in_pieces_and_have_their_sidecars(spark, tmp_path):
    import hashlib

    from panelweft.sources import readers

    (tmp_path / "a b.txt").write_bytes(b"x" * 100_000)
    (tmp_path / "a b.txt.meta.json").write_text('{"tags": ["t"], "title": "T", "compiled": true}')
    (tmp_path / "c.bin").write_bytes(b"y")
    (tmp_path / "d.md").write_text("# D")
    (tmp_path / "d.md.meta.yml").write_text("original_name: report d.md\ntags:\n- alpha\n- beta\ncategory: ''\ncompiled: true\ningested_at: 20240101T000000Z\n")
    (tmp_path / "c.bin.meta.yml").write_text("original_name: c.bin\ntags: []\n")
    (tmp_path / "e.md.meta.yml").write_text("\n")
    got = {r["original_name"]: r for r in readers.ingested(spark, str(tmp_path)).collect()}
    assert got["c.bin"]["sha256"] == hashlib.sha256(b"y").hexdigest() and got["c.bin"]["tags"] == [] and not got["c.bin"]["compiled"]
    assert got["d.md"]["tags"] == ["alpha", "beta"] and got["d.md"]["compiled"] and set(got) >= {"c.bin", "d.md"} and len(got) == 3
    side = readers.sidecars(spark, str(tmp_path))
    assert {r["original_name"] for r in knowledge.stale_sources(side).collect()} == {"c.bin", "e.md"}
    one = next(v for k, v in got.items() if k.startswith("a"))
    assert one["sha256"] == hashlib.sha256(b"x" * 100_000).hexdigest() and one["size_bytes"] == 100_000


def test_a_large_csv_is_read_in_several_tasks(spark, tmp_path):
    from panelweft.sources import readers

    (tmp_path / "big.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(400_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        df = readers.csv(spark, str(tmp_path / "big.csv"), columns=["a"])
        assert df.rdd.getNumPartitions() > 4 and df.count() == 400_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_suites_of_state_and_api(spark):
    df = frame(spark, [("A", 2015, 1.0, 0.5, 9.0, None, "High"), ("A", 2015, None, 0.6, 1.0, 101.0, "Odd"), ("B", 2030, 2.0, 0.1, 1.0, 5.0, "Low")], "state_name string, year int, composite_score double, ACC_score double, Z_x double, SKL_fem_literacy double, model_trust_tier string")
    found = {i["check"] for i in verify.check_state(df).issues}
    assert found == {"duplicate_keys", "null_score", "extreme_Z_x", "range_SKL_fem_literacy", "sparse_domains"}
    assert verify.check_state(df.drop("year")).has_errors
    api = {i["check"] for i in verify.check_api(df, (2014, 2025), entity="state_name").issues}
    assert {"duplicate_keys", "null_score", "year_max", "tiers_known", "rows", "domain_SKL_score"} <= api and "year_min" not in api


def test_reports_and_slides(spark):
    from panelweft.operators import knowledge

    docs = knowledge.articles(frame(spark, [(f"wiki/a/{i}.md", f"# Title {i}\n\nWater and more water flows in the river of place number {i}." + " desert" * (i == 2)) for i in range(4)], "path string, content string"))
    out = knowledge.report(docs, "desert")
    assert out.startswith("# desert") and "## Title 2" in out and "Title 1" not in out
    assert knowledge.slides(docs, "desert").count("---") == 1
    assert knowledge.master_index(docs).count() == 4


def test_seeded_draws(spark):
    from pyspark.sql import functions as F

    from panelweft.functions import exprs as X

    r = spark.range(20_000).select(X.normal(1, "id").alias("n"), X.poisson(3.0, 2, "id").alias("p"), X.chosen(["a", "b"], 3, "id").alias("c")).agg(F.avg("n"), F.stddev("n"), F.avg("p"), F.var_samp("p"), F.avg((F.col("c") == "a").cast("double"))).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03 and abs(r[2] - 3) < 0.06 and abs(r[3] - 3) < 0.15 and abs(r[4] - 0.5) < 0.02


def test_news_turn(spark):
    schema = "article_id string, title string, summary string, published_at timestamp, country_iso3 string"
    day = lambda n: dt.datetime(2024, 1, n)
    kw = [("ACC", "en", "net"), ("ECO", "en", "bank")]
    first = tracks.news(None, frame(spark, [("a", "Net", "", day(1), "IND"), ("b", "x", None, None, "IND")], schema), kw, now="2024-01-20")
    old = first["intake"]
    assert first["totals"].first()["n"] == 2 and {tuple(r) for r in first["domains"].collect()} == {("ACC", 1), ("UNMAPPED", 1)}
    new = frame(spark, [("c", "Bank", "", day(19), "KEN"), ("b", "net", "", day(18), "IND")], schema)
    turn = tracks.news(old, new, kw, now="2024-01-20")
    assert {(r["article_id"], r["primary_domain"]) for r in turn["intake"].collect()} == {("b", "ACC"), ("c", "ECO")}
    assert {tuple(r) for r in turn["groups"].collect()} == {("IND", 1, 1, 1.0), ("KEN", 1, 1, 1.0)}
    none = tracks.news(old.limit(0), new.limit(0), kw, now="2024-01-20")
    assert none["groups"].count() == 0 and none["totals"].first()["n"] == 0


def test_word_chunks_split_a_text_once(spark):
    chunks = X.word_chunks("t", 3, 1)
    assert str(chunks).count("split(") == 1
    rows = spark.createDataFrame([(" ".join(map(str, range(n))),) for n in range(12)] + [(None,)], "t string").select("t", chunks.alias("c")).collect()
    for t, c in rows:
        w = (t or "").split()
        assert c == [" ".join(w[i : i + 3]) for i in range(0, len(w), 2) if i == 0 or i + 1 < len(w)]


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_jaccard_whatever_the_table_of_frequent_tokens(spark, monkeypatch, frequent):
    monkeypatch.setattr(text, "FREQUENT", frequent)
    rng = np.random.default_rng(8)
    sets = [frozenset(rng.choice(60, rng.integers(1, 25), replace=False).tolist()) for _ in range(60)]
    sets += [s ^ {int(rng.integers(60))} for s in sets for _ in range(2)] + [frozenset(range(900)), frozenset(range(40, 900)), frozenset()]
    df = spark.createDataFrame([(i, [f"t{x}" for x in s]) for i, s in enumerate(sets)], "id int, k array<string>")
    rep = {s: i for i, s in reversed(list(enumerate(sets)))}
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and y and len(x & y) >= 0.7 * len(x | y) and rep[x] == i and (rep[y] in (i, j))}
    assert {(r["a"], r["b"]) for r in text.jaccard_pairs(df, "id", "k", 0.7).collect()} == want


def test_backlinks_search_copies_once(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(text, "containing", lambda texts, needles, **o: searched.append((texts.count(), needles.count())) or mentions.containing(texts, needles, **o))
    data = [(3 * i + k, t, body) for i in range(5) for k, (t, body) in enumerate([("Alpha", "of beta and gamma"), ("beta", "Alpha alone"), ("Beta", "OF beta and gamma")])] + [(20, None, "alpha"), (21, "", None)]
    got = text.backlinks(frame(spark, data, "id long, title string, text string"), "id", "title", "text").collect()
    assert {(r["src"], r["dst"]) for r in got} == contained(data) and len(got) == len(contained(data))
    assert searched == [(3, 3)]


def test_containment_shuffles_nothing_whatever_the_bounds(spark, monkeypatch):
    """Needles are looked up in the scan: in several tables, over slabs that end inside needles, a few candidates at a time."""
    rng = np.random.default_rng(21)
    word = lambda n: "".join(rng.choice(list("ab .É"), n))
    texts = [(i, word(rng.integers(0, 300))) for i in range(80)] + [(80, "a" * 400), (81, None), (82, "")]
    needles = [*{word(rng.integers(1, 30)) for _ in range(100)}, *{t[a : a + n] for _, t in texts[:80] for a, n in [(rng.integers(300), rng.integers(1, 200))]}, "a" * 399, "a" * 401, ""]
    left, right = frame(spark, texts, "id long, text string"), frame(spark, list(enumerate(needles)) + [(-1, None)], "k long, needle string")
    want = {(i, k) for i, t in texts for k, n in enumerate(needles) if n and n in (t or "")}
    for bounds in ({}, {"TABLE": 2000, "SLAB": 37, "CANDIDATES": 5, "FOUND": 7, "SLOTS": 2}):
        for name, value in bounds.items():
            monkeypatch.setattr(mentions, name, value)
        pairs = mentions.containing(left, right)
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in pairs.collect()]
        assert set(got) == {(i, needles[k]) for i, k in want} and len(got) == len(set(got))
        lists = [(r["id"], k) for r in mentions.containing(left, right, key_col="k").collect() for k in r["keys"]]
        assert set(lists) == want and len(lists) == len(want)


def test_backlinks_of_titles_of_many_documents(spark, monkeypatch):
    """A title's documents in parts; copies that share their bits with other ids; a repeated document."""
    for module, name, value in ((text, "PART", 3), (text, "LEAST_BITS", 256), (text, "MOST_BITS", 512)):
        monkeypatch.setattr(module, name, value)
    data = [(i, ("Alpha", "beta", "Gamma delta", None)[i % 4], ("of beta", "ALPHA alone", "gamma delta, alpha", None, f"beta {i}", "none")[i % 6]) for i in range(100)]
    df = frame(spark, data + data[:1], "id long, title string, text string")
    got = [(r["src"], r["dst"]) for r in text.backlinks(df, "id", "title", "text").collect()]
    both = [(a, b) for a, own, body in data + data[:1] for b, title, _ in data + data[:1] if title and own != title and title.lower() in (body or "").lower()]
    assert sorted(got) == sorted(both)


def test_few_texts_are_shuffled_to_tell_copies(spark):
    rows = spark.range(5000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    out = text._firsts(rows, spark.range(5000).select("id", (F.col("id") % 7 == 3).alias("copy")))
    assert sorted(r["id"] for r in out.collect()) == [i for i in range(5000) if i % 7 != 3]
    joins = re.findall(r"Join (\w+)", out._jdf.queryExecution().optimizedPlan().toString())
    assert joins == ["LeftOuter", "LeftAnti", "LeftOuter"]  # of the one branch, and of the other, where the join of ids is above that of bits
