"""Order statistics of big groups against numpy and pandas; small and cells are lowered so that every pass runs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweft.functions import order


def values(rnd, kind):
    one = {"plain": lambda: rnd.uniform(-5, 5), "wild": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300), "ties": lambda: float(rnd.randrange(3)), "close": lambda: 1 + rnd.randrange(9) * 2.0**-50, "whole": lambda: float(rnd.randrange(-50, 50))}[kind]
    return [None if rnd.random() < 0.1 else float("nan") if rnd.random() < 0.05 else one() for _ in range(300)]


@pytest.mark.parametrize("small,cells", [(order.SMALL, order.CELLS), (7, 1 << 16), (3, 4)])
def test_quantiles(spark, small, cells):
    rnd, kinds = random.Random(1), ("plain", "wild", "ties", "close", "whole")
    data = [(k, *x) for k in (*kinds, None) for x in zip(values(rnd, k or "whole"), values(rnd, "plain"), strict=True)]
    data += [("none", None, None), ("one", 4.0, None), ("ends", float("inf"), 1.0), ("ends", float("-inf"), 2.0), ("ends", 0.0, 3.0), ("ends", float("inf"), 3.0)]
    probs = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    df = spark.createDataFrame(data, "k string, a double, b double")
    got = {r["k"]: r for r in order.quantiles(df, ["a", "b"], probs, ["k"], small=small, cells=cells).collect()}
    assert len(got) == 9
    for k, r in got.items():
        for j in (0, 1):
            x = sorted(v[1 + j] for v in data if v[0] == k and v[1 + j] is not None and v[1 + j] == v[1 + j])
            for i, p in enumerate(probs):
                at = p * (len(x) - 1)
                if not x:
                    assert r[f"q{j}_{i}"] is None
                elif k != "ends":
                    lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
                    assert r[f"q{j}_{i}"] == pytest.approx(lo if lo == hi else lo + (hi - lo) * (at - np.floor(at)), rel=1e-12)
    assert got["ends"]["q0_0"] == float("-inf") and got["ends"]["q0_5"] == float("inf")
    whole = order.quantiles(df, ["b"], [0.5], small=small, cells=cells).collect()
    assert len(whole) == 1 and whole[0]["q0_0"] == pytest.approx(np.median([v[2] for v in data if v[2] is not None and v[2] == v[2]]))
    assert order.quantiles(df.limit(0), ["a"], [0.5]).collect()[0]["q0_0"] is None and order.quantiles(df.limit(0), ["a"], [0.5], ["k"]).count() == 0


@pytest.mark.parametrize("small", [order.SMALL, 40])
def test_ranks_and_sums(spark, small, monkeypatch):
    monkeypatch.setattr(order, "DEALT_ROWS", 50)
    rnd = random.Random(2)
    data = [(g, i, rnd.choice([None, *map(float, range(12))]), rnd.randrange(5)) for g, n in (("big", 400), (None, 300), ("small", 20), ("two", 2)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, i int, v double, w long")
    big = order.big_groups(df, ["g"], small)
    assert (big is None) == (small == order.SMALL)
    pdf = pd.DataFrame(data, columns=["g", "i", "v", "w"])
    key = pdf["g"].fillna("~")
    for descending in (True, False):
        got = order.average_ranks(df, "v", "r", ["g"], descending=descending, big=big).toPandas().sort_values(["g", "i"]).reset_index(drop=True)
        want = pdf.assign(r=pdf["v"].groupby(key).rank(ascending=not descending)).sort_values(["g", "i"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)
    got = order.running(df, ["g"], [F.col("w").desc(), F.col("i")], "w", "s", big=big).toPandas().sort_values(["g", "i"]).reset_index(drop=True)
    by = pdf.sort_values(["w", "i"], ascending=[False, True])
    want = by.assign(s=by["w"].groupby(by["g"].fillna("~")).cumsum()).sort_values(["g", "i"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    nth = order.numbered(df, ["g"], [F.col("i").desc()], "n", big=big).collect()
    assert all(r["n"] == {"big": 400, None: 300, "small": 20, "two": 2}[r["g"]] - r["i"] for r in nth)
