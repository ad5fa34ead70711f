"""Statistics over frames: robust normalisation, quantile fences, correlation, ranks.

Global statistics are aggregates joined back by broadcast (one row, or one row a group
where groups are few by nature: years, indicators), never windows without a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweft.functions.exprs import _col
from panelweft.functions.order import average_ranks, big_groups, quantiles
from panelweft.session import ship, stored


def _back(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """stats (a row, or a row a group) beside each row of df; Spark broadcasts them if they are small enough."""
    if not by:
        return df.crossJoin(F.broadcast(stats))  # one row
    on = [df[k].eqNullSafe(stats[k]) for k in by]
    return df.join(stats, on, "left").drop(*[stats[k] for k in by])


def winsor_bounds(df: DataFrame, column: str, by: Sequence[str] = (), low: float = 0.05, high: float = 0.95) -> DataFrame:
    """by, lo, hi: exact interpolated quantiles."""
    return quantiles(df, [column], [low, high], by).withColumnsRenamed({"q0_0": "lo", "q0_1": "hi"})


def winsor_zscores(df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), ddof: int = 1, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Of each column: its name for the result. Clip to quantiles, then standardise; 0 for every row (null ones too) where nothing varies.

    All columns share the passes for the bounds and one aggregate for the moments.
    """
    df = stored(df)
    bounds = quantiles(df, list(columns), [low, high], by, kept=True).withColumnsRenamed({f"q{j}_{i}": f"_{n}_{c}" for j, c in enumerate(columns) for i, n in enumerate(("lo", "hi"))})
    cut = _back(df, bounds, by).withColumns({f"_w_{c}": F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_hi_{c}")), F.col(f"_lo_{c}"))) for c in columns})
    cut = cut.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])
    sd = F.stddev_samp if ddof else F.stddev_pop
    moments = cut.groupBy(*by).agg(*[f(f"_w_{c}").alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", sd))])
    z = {out: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 0.0).otherwise((F.col(f"_w_{c}") - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c, out in columns.items()}
    return _back(cut, moments, by).withColumns(z).drop(*[f"_{n}_{c}" for c in columns for n in ("w", "m", "s")])


def winsor_zscore(df: DataFrame, column: str, out: str, by: Sequence[str] = (), ddof: int = 1, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return winsor_zscores(df, {column: out}, by, ddof, low, high)


def tukey_clip(df: DataFrame, columns: Sequence[str], k: float = 2.95, by: Sequence[str] = ()) -> DataFrame:
    """Clip columns to k interquartile ranges beyond the quartiles."""
    df = stored(df)
    q = quantiles(df, columns, [0.25, 0.75], by, kept=True).withColumnsRenamed({f"q{j}_{i}": f"_{c}_{n}" for j, c in enumerate(columns) for i, n in enumerate("ab")})
    wide = _back(df, q, by)
    for c in columns:
        a, b = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        wide = wide.withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), b + k * (b - a)), a - k * (b - a))))
    return wide.drop(*[f"_{c}_{n}" for c in columns for n in "ab"])


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of complete pairs; null where a side doesn't vary (the built-in raises)."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    den = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(den != 0, den))


def _about(x: str, mean: str) -> Column:
    """x less its mean; what only rounding of the mean makes is 0."""
    d = F.col(x) - F.col(mean)
    return F.when(F.abs(d) <= F.abs(F.col(mean)) * 1e-13, F.lit(0.0)).otherwise(d)


#: Codes whose matrix of pairs a task may hold; more are paired by a join.
MAX_CODES = 2048


def corr_pairs(long: DataFrame, code: str, keys: Sequence[str], value: str) -> DataFrame:
    """(a, b, n, corr) of every pair of codes a < b, over the keys that both have a value of; values of one key and code are averaged.

    A key's values are a row, and tasks add up partial Gram matrices of their rows under the
    masks of what is observed: nothing is paired row by row, and a code's pairs cost a cell each.
    """
    spark = long.sparkSession
    ship(spark)
    one = stored(long.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(code).alias("_code")).agg(F.avg(F.col(value).cast("double")).alias("_x")))
    means = one.groupBy("_code").agg(F.avg("_x").alias("_mean")).orderBy("_code").limit(MAX_CODES + 1).collect()
    if len(means) > MAX_CODES:
        right = one.select(*keys, F.col("_code").alias("b"), F.col("_x").alias("_y"))
        return one.withColumnRenamed("_code", "a").join(right, list(keys)).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), correlation("_x", "_y").alias("corr"))
    kind = long.schema[code].dataType.simpleString()
    names = spark.createDataFrame([(r[0], i, r[1]) for i, r in enumerate(means)], f"_code {kind}, _i int, _mean double")
    rows = one.join(F.broadcast(names), "_code").groupBy(*keys).agg(F.collect_list(F.struct("_i", _about("_x", "_mean").alias("_x"))).alias("v")).select("v")
    k = len(means)

    def grams(batches):
        total = [np.zeros((k, k)) for _ in range(4)]  # counts, sums, squares, products
        for batch in batches:
            v = batch.column(0)
            for at in range(0, len(v), 1024):
                part = v.slice(at, 1024)
                flat = part.flatten()
                row = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets)))
                x, seen = np.zeros((len(part), k)), np.zeros((len(part), k))
                col = np.asarray(flat.field(0))
                x[row, col], seen[row, col] = np.asarray(flat.field(1)), 1.0
                for t, (p, q) in zip(total, ((seen, seen), (x, seen), (x * x, seen), (x, x)), strict=True):
                    t += p.T @ q
        n, s, ss, xy = total
        a, b = np.nonzero(np.triu(n, 1))
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i.astype(np.int32), j.astype(np.int32), n[i, j].astype(np.int64), s[i, j], s[j, i], ss[i, j], ss[j, i], xy[i, j])], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    g = rows.mapInArrow(grams, "i int, j int, n long, x double, y double, xx double, yy double, xy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = lambda square, total: F.when(F.col(square) - F.col(total) * F.col(total) / F.col("n") > 1e-12 * F.col(square), F.col(square) - F.col(total) * F.col(total) / F.col("n"))
    corr = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(spread("xx", "x")) * F.sqrt(spread("yy", "y")))
    name = lambda i, c: F.broadcast(names.select(F.col("_i").alias(i), F.col("_code").alias(c)))
    return g.join(name("i", "a"), "i").join(name("j", "b"), "j").select("a", "b", "n", corr.alias("corr"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], min_n: int = 5) -> DataFrame:
    """(by, n, rho) of complete pairs, for groups of at least min_n."""
    full = stored(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*by, x, y])))
    big = big_groups(full, by)
    ranked = average_ranks(average_ranks(full, x, "_x", by, descending=False, big=big), y, "_y", by, descending=False, big=big)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("_x", "_y").alias("rho")).filter(F.col("n") >= min_n)


def mask_moments(wide: DataFrame, groups: dict[str, Sequence[str]]) -> dict[str, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """Of each group of columns, by mask of observed columns (bit i: column i): rows, sums and cross products, about the columns' means.

    One job for all groups and masks; what is missing counts as 0 and is not in the mask.
    """
    names = sorted({c for cs in groups.values() for c in cs})
    most = max((len(cs) for cs in groups.values()), default=0)
    if not most:
        return {}
    rows = wide.select(*[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    means = rows.agg(*[F.avg(f"_v{i}").alias(f"_m{i}") for i in range(len(names))])
    about = {c: _about(f"_v{i}", f"_m{i}") for i, c in enumerate(names)}
    values = lambda cs: F.array(*[F.coalesce(about[c], F.lit(0.0)) for c in cs], *[F.lit(0.0)] * (most - len(cs)))
    mask = lambda cs: sum((F.when(about[c].isNotNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(cs)), F.lit(0)).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), mask(cs).alias("mask"), values(cs).alias("v")) for g, cs in groups.items()]))
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    got = rows.crossJoin(F.broadcast(means)).select(each.alias("r")).select("r.*").groupBy("g", "mask").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(most)], *[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"p{i}_{j}") for i, j in pairs])
    out: dict[str, dict[int, tuple[int, np.ndarray, np.ndarray]]] = {g: {} for g in groups}
    for r in got.collect():  # a row for each mask that occurs
        cross = np.zeros((most, most))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = r[f"p{i}_{j}"]
        out[r["g"]][r["mask"]] = (r["n"], np.array([r[f"s{i}"] for i in range(most)]), cross)
    return out


def complete(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], columns: Sequence[int]) -> tuple[int, np.ndarray]:
    """Rows in which all of the columns (by place) are observed, and their centred cross products."""
    need = sum(1 << i for i in columns)
    n, s, cross = 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    for mask, (m, sums, products) in moments.items():
        if mask & need == need:
            n, s, cross = n + m, s + sums[columns], cross + products[np.ix_(columns, columns)]
    return n, cross - np.outer(s, s) / n if n else cross


def inflations(cross: np.ndarray) -> list[float]:
    """Variance inflation of each column given the others, from centred cross products; infinite where they explain it."""
    out = []
    size = np.sqrt(np.clip(cross.diagonal(), 0, None))
    scale = np.where(size > 0, size, 1.0)
    cross = cross / np.outer(scale, scale)  # as correlations: columns of any unit weigh alike in the pseudo-inverse
    for j in range(len(cross)):
        total = cross[j, j]
        rest = [i for i in range(len(cross)) if i != j]
        b = np.linalg.pinv(cross[np.ix_(rest, rest)]) @ cross[rest, j]
        r2 = 0.0 if total <= 0 else float(b @ cross[rest, j] / total)
        out.append(float("inf") if r2 >= 0.999999 else 1.0 / max(1e-8, 1.0 - r2))
    return out


def vif(df: DataFrame, columns: Sequence[str], min_rows: int = 10) -> dict[str, float | None]:
    """Variance inflation of each column given the others, over complete rows; null with too few of these."""
    n, cross = complete(mask_moments(df.select(*columns).dropna(), {"": list(columns)}).get("", {}), list(range(len(columns))))
    if n < min_rows or len(columns) < 2:
        return {c: (1.0 if n >= min_rows else None) for c in columns}
    return dict(zip(columns, inflations(cross), strict=True))
