"""Rows of a Spark query and of its SQL, in one form."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _plain(v):
    """Nulls alike, numbers as doubles (a nullable column of integers is one of doubles on one side), all else as text."""
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, numbers.Real) and not isinstance(v, bool | np.bool_) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for r in pdf.itertuples(index=False):
        out.append(tuple(_plain(v) for v in r))
    return sorted(out, key=repr)


def close(a, b):
    """The same rows, doubles to a unit of the last place that is compared."""
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            assert v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 2e-4 * max(1, abs(v))), (x, y)
