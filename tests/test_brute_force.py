"""Selections, correlations, stability and placebo against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweft.functions import order
from panelweft.functions import stats as S
from panelweft.operators import econometrics, gating, panel as panels


def panel(seed, n=240, missing=0.15):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 3))
    cols = {"a": base[:, 0], "b": base[:, 0] + rng.normal(size=n) * 0.05, "c": base[:, 1] * 1e6 + 5e8, "d": base[:, 0] + base[:, 1] + base[:, 2] + rng.normal(size=n) * 0.01, "e": base[:, 2], "f": np.full(n, 7.3), "g": rng.integers(0, 3, n).astype(float), "h": base[:, 0] - base[:, 1] + rng.normal(size=n) * 0.02}
    df = pd.DataFrame(cols)
    for c in df:
        df.loc[rng.random(n) < missing, c] = np.nan
    df["economy"], df["year"] = np.arange(n) // 8, 2000 + np.arange(n) % 8
    return df


def as_long(spark, df):
    long = df.melt(["economy", "year"], var_name="indicator_code", value_name="value").dropna()
    return spark.createDataFrame(long.astype({"economy": int, "year": int}))


def plain_vif(df):
    x = df.dropna()
    z = ((x - x.mean()) / x.std(ddof=0).replace(0, np.nan)).dropna()
    if len(z) < 10:
        return None
    out = {}
    for c in z:
        rest = np.column_stack([np.ones(len(z)), z.drop(columns=c).to_numpy()])
        b = np.linalg.lstsq(rest, z[c], rcond=None)[0]
        r2 = 1 - ((z[c] - rest @ b) ** 2).sum() / ((z[c] - z[c].mean()) ** 2).sum()
        out[c] = np.inf if r2 >= 0.999999 else 1 / max(1e-8, 1 - r2)
    return out


def plain_pruning(df, codes, scores, limit, max_vif, min_keep):
    corr, gone = df[codes].corr().abs(), set()
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if a not in gone and b not in gone and corr.loc[a, b] >= limit:
                gone.add(b if scores[a] >= scores[b] else a)
    kept = [c for c in codes if c not in gone]
    while len(kept) > max(min_keep, 2):
        got = plain_vif(df[kept])
        if not got or max(got.values()) <= max_vif:
            break
        kept.remove(max(got, key=got.get))
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_pruning(spark, seed):
    df = panel(seed)
    long = as_long(spark, df)
    domains = {"ACC": list("abde"), "SKL": list("cegh"), "ECO": list("adehc"), "OUT": ["f"], "AGR": list("fag")}
    rng = np.random.default_rng(seed)
    for options in ({}, {"max_corr": 0.5, "max_vif": 2.0}, {"max_corr": 1.1, "max_vif": 1.5, "min_keep": 3}):
        scores = {c: float(rng.integers(0, 3)) for c in "abcdefgh"}
        full = {"max_corr": 0.9, "max_vif": 10.0, "min_keep": 1} | options
        want = {d: plain_pruning(df, cs, scores, full["max_corr"], full["max_vif"], full["min_keep"]) for d, cs in domains.items()}
        assert gating.pruned(long, domains, scores, **options) == want


def test_correlations_of_all_pairs(spark, monkeypatch):
    df = panel(3)
    long = as_long(spark, df)
    codes = list("abcdefgh")
    for most in (S.MAX_CODES, 2):  # the second pairs by a join
        monkeypatch.setattr(S, "MAX_CODES", most)
        got = {(r["a"], r["b"]): r for r in S.corr_pairs(long, "indicator_code", ["economy", "year"], "value").collect()}
        assert len(got) == 28
        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                both = df[[a, b]].dropna()
                assert got[a, b]["n"] == len(both)
                if "f" in (a, b):
                    assert got[a, b]["corr"] is None or most == 2
                else:
                    assert got[a, b]["corr"] == pytest.approx(both[a].corr(both[b]), abs=1e-9)
    assert S.corr_pairs(long.limit(0), "indicator_code", ["economy", "year"], "value").count() == 0


def test_vif_is_that_of_plain_regressions(spark):
    df = panel(4)
    got = S.vif(spark.createDataFrame(df), list("acegh"))
    want = plain_vif(df[list("acegh")])
    assert {c: got[c] for c in want} == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("small", [order.SMALL, 10])
def test_rank_stability(spark, small, monkeypatch):
    monkeypatch.setattr(order.big_groups, "__defaults__", (small,))
    rng = np.random.default_rng(6)
    data = [(f"e{i}", t, *[None if rng.random() < 0.2 else float(rng.normal()) for _ in range(3)]) for t, n in ((1, 25), (2, 6)) for i in range(n)]
    df = spark.createDataFrame(data, "e string, t int, a double, b double, c double")
    got = {(r["e"], r["t"]): r for r in econometrics.rank_stability(df, list("abc"), "e", "t", draws=30, top=5).collect()}
    weights = econometrics.weight_draws(df, "t", list("abc"), 30, 42).toPandas()
    assert np.allclose(weights[["w_a", "w_b", "w_c"]].sum(axis=1), 1) and weights["w_a"].std() > 0.1
    x = pd.DataFrame(data, columns=list("etabc")).merge(weights, on="t")
    w, v = x[["w_a", "w_b", "w_c"]].to_numpy(), x[list("abc")].to_numpy(float)
    seen = ~np.isnan(v)
    x["s"] = (np.nan_to_num(v) * w).sum(axis=1) / np.where(seen.any(axis=1), (seen * w).sum(axis=1), np.nan)
    x["r"] = x.groupby(["t", "draw"])["s"].rank(ascending=False)
    want = x.dropna(subset=["r"]).groupby(["e", "t"])["r"]
    assert set(got) == set(want.groups)
    for key, r in want:
        assert got[key]["mean_rank"] == pytest.approx(r.mean()) and got[key]["sd_rank"] == pytest.approx(r.std()) and got[key]["top_share"] == pytest.approx((r <= 5).mean())


@pytest.mark.parametrize("small", [order.SMALL, 10])
def test_placebo_permutes_by_hash(spark, small, monkeypatch):
    monkeypatch.setattr(order.big_groups, "__defaults__", (small,))
    rng = np.random.default_rng(9)
    data = [(f"e{i:02}", t, float(i), None if rng.random() < 0.2 else float(i * 10)) for t, n in ((1, 40), (2, 7), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(data, "e string, t int, v double, w double")
    got = econometrics.placebo(df, ["v", "w"], "e", "t", 7).toPandas().set_index(["t", "e"])
    keys = df.select("e", *[F.xxhash64(F.lit(7), F.lit(c), F.col("e")).alias(c) for c in "vw"]).distinct().toPandas().set_index("e")
    x = pd.DataFrame(data, columns=list("etvw"))
    assert len(got) == len(x)
    for _, own in x.groupby("t", dropna=False):
        names = sorted(own["e"])
        for c in "vw":
            values = own.set_index("e")[c]
            dealt = sorted(names, key=lambda e: (keys.loc[e, c], e))  # noqa: B023
            new = [got.loc[(own["t"].iloc[0], e), c] if own["t"].notna().all() else got[got.index.get_level_values("t").isna()].droplevel("t").loc[e, c] for e in names]
            np.testing.assert_array_equal(np.array(new, float), values.loc[dealt].to_numpy(float))
            assert len(names) < 5 or list(new) != list(values.loc[names])


@pytest.mark.parametrize("apart", [False, True])
def test_exact_effects(spark, apart):
    """Residuals of a regression on all dummies: unbalanced, with repeated cells, in parts that share no time, nulls as keys."""
    rng = np.random.default_rng(11)
    rows = [(f"e{i}" if i else None, (t if i % 2 else t + 20) if apart else t, float(rng.normal() + i + t * t), float(rng.normal() * 1e3 + t)) for i in range(14) for t in range(9) if rng.random() < 0.6 for _ in range(rng.integers(1, 3))]
    df = pd.DataFrame(rows, columns=["e", "t", "x", "y"])
    dummies = np.column_stack([pd.get_dummies(df["e"].fillna("~")).to_numpy(float), pd.get_dummies(df["t"]).to_numpy(float)])
    want = df[["x", "y"]].to_numpy() - dummies @ np.linalg.lstsq(dummies, df[["x", "y"]].to_numpy(), rcond=None)[0]
    numbered = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, e string, t int, x double, y double")
    got = panels.demean_exact(numbered, ["x", "y"], "e", "t").orderBy("n").toPandas()
    assert list(got.columns) == ["n", "e", "t", "x", "y"]
    np.testing.assert_allclose(got[["x", "y"]].to_numpy(), want, atol=1e-7)
    assert panels.demean_exact(numbered.limit(0), ["x"], "e", "t").count() == 0
