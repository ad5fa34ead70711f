"""Panel regressions from distributed sufficient statistics, and their robustness checks.

Rows never leave the executors: the driver solves k x k systems from sums of products.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.order import SMALL, average_ranks, big_groups, numbered
from panelweft.functions.stats import _back, spearman
from panelweft.operators.panel import demean, demean_exact, shifted
from panelweft.session import stored


def p_value(t: float | None) -> float | None:
    """Two-sided, normal."""
    return None if t is None or math.isnan(t) else math.erfc(abs(t) / math.sqrt(2))


@dataclass
class Fit:
    """Coefficients and fit statistics of one regression."""

    names: list[str]
    coef: list[float]
    se: list[float]
    n: int
    n_entities: int
    n_times: int
    absorbed: int
    df_residual: int
    r2: float
    adj_r2: float
    f: float
    residual_sd: float
    durbin_watson: float | None
    stats: dict = field(default_factory=dict)

    @property
    def t(self) -> list[float | None]:
        return [c / s if s > 0 else None for c, s in zip(self.coef, self.se, strict=True)]

    @property
    def p(self) -> list[float | None]:
        return [p_value(t) for t in self.t]

    @property
    def interval(self) -> list[tuple[float, float]]:
        return [(c - 1.96 * s, c + 1.96 * s) for c, s in zip(self.coef, self.se, strict=True)]


def _ends(df: DataFrame, residual: str, entity: str, time: str, *more) -> DataFrame:
    """A row an entity: _d, its squared successive differences, _s, its squared residuals, its _first and _last residual, and more sums."""
    step = F.col(residual) - F.lag(residual).over(Window.partitionBy(entity).orderBy(time))
    moved = df.withColumn("_step", step)
    return moved.groupBy(entity).agg(F.coalesce(F.sum(F.col("_step") * F.col("_step")), F.lit(0.0)).alias("_d"), F.sum(F.col(residual) * F.col(residual)).alias("_s"), F.min_by(residual, time).alias("_first"), F.max_by(residual, time).alias("_last"), *more)


def _linked(ends: DataFrame, entity: str, big) -> DataFrame:
    """ends with _link: the squared difference between an entity's first residual and the last one of the entity before."""
    jump = lambda before: (F.col("_first") - before) * (F.col("_first") - before)
    if big is None:
        return ends.withColumn("_link", jump(F.lag("_last").over(Window.orderBy(entity))))  # a row an entity, of few entities
    nth = numbered(ends, [], [F.col(entity)], "_k", big=big)
    return nth.join(nth.select((F.col("_k") + 1).alias("_k"), F.col("_last").alias("_before")), "_k", "left").withColumn("_link", jump(F.col("_before")))


def durbin_watson(df: DataFrame, residual: str, entity: str, time: str, per_entity: bool = False) -> DataFrame:
    """(dw): squared successive differences over squared residuals, in (entity, time) order.

    Without per_entity a difference crosses from an entity's last row to the next entity's
    first: those links are taken from a table of entities, not from one sorted partition.
    """
    ends = _ends(df, residual, entity, time)
    if not per_entity:
        ends = stored(ends)
        ends = _linked(ends, entity, big_groups(ends, []))
    both = F.sum("_d") if per_entity else F.sum("_d") + F.coalesce(F.sum("_link"), F.lit(0.0))
    return ends.agg(both.alias("_n"), F.sum("_s").alias("_s")).select(F.try_divide("_n", F.when(F.col("_s") != 0, F.col("_s"))).alias("dw"))


def ols(df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str, *, entity_effects: bool = True, time_effects: bool = True, exact: bool = False, clustered: bool = True) -> Fit:
    """Least squares with absorbed effects, pseudo-inverse and entity-clustered errors; raises with fewer than k + 5 rows."""
    cols = [y, *xs]
    use = df.select(entity, time, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    if entity_effects and time_effects and exact:
        use = demean_exact(use, cols, entity, time)
    elif entity_effects or time_effects:
        use = demean(use, cols, entity if entity_effects else None, time if time_effects else None)
    use = use.cache()
    try:
        return _solve(use, y, list(xs), entity, time, entity_effects, time_effects, clustered)
    finally:
        use.unpersist()


def _solve(use, y, xs, entity, time, entity_effects, time_effects, clustered) -> Fit:
    k, cols = len(xs), [*xs, y]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    row = use.agg(F.count("*").alias("n"), F.count_distinct(entity).alias("g"), F.count_distinct(time).alias("t"), F.avg(y).alias("my"), *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n, g, t = row["n"], row["g"], row["t"]
    if n < k + 5:
        raise ValueError(f"{n} rows are too few for {k} regressors")
    gram = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"p{i}_{j}"] or 0.0
    inv = np.linalg.pinv(gram[:k, :k])
    beta = inv @ gram[:k, k]
    resid = F.col(y) - sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    absorbed = (g - 1 if entity_effects else 0) + (t - 1 if time_effects else 0) + (1 if entity_effects or time_effects else 0)
    df_res = n - k - absorbed
    # One more pass: residuals, scores and successive differences, summed by entity and then over entities.
    ends = _ends(use.withColumn("_u", resid), "_u", entity, time, *[F.sum(F.col(x) * F.col("_u")).alias(f"_s{i}") for i, x in enumerate(xs)])
    big = None
    if g > SMALL:
        ends = stored(ends)
        big = big_groups(ends, [])
    sq = [(i, j) for i in range(k) for j in range(i, k)]
    sums = _linked(ends, entity, big).agg(F.sum("_s").alias("ssr"), (F.sum("_d") + F.coalesce(F.sum("_link"), F.lit(0.0))).alias("steps"), *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"m{i}_{j}") for i, j in sq]).first()
    ssr = float(sums["ssr"] or 0.0)
    if clustered:
        meat = np.zeros((k, k))
        for i, j in sq:
            meat[i, j] = meat[j, i] = sums[f"m{i}_{j}"] or 0.0
        scale = (g / (g - 1)) * ((n - 1) / max(1, n - k)) if g > 1 else 1.0
        cov = scale * inv @ meat @ inv
    else:
        cov = inv * (ssr / max(1, df_res))
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    sst = gram[k, k] - (0.0 if entity_effects or time_effects else n * (row["my"] or 0.0) ** 2)
    r2 = 1 - ssr / sst if sst > 0 else 0.0
    f = (r2 / k) / ((1 - r2) / df_res) if k and df_res > 0 and r2 < 1 else float("nan")
    dw = sums["steps"] / ssr if ssr else None
    return Fit(xs, beta.tolist(), se.tolist(), n, g, t, absorbed, df_res, r2, 1 - (1 - r2) * (n - 1) / df_res if df_res > 0 else float("nan"), f, math.sqrt(ssr / df_res) if df_res > 0 else float("nan"), dw, {"ssr": ssr, "sst": sst})


def ols_with_constant(df: DataFrame, y: str, xs: Sequence[str], entity: str, time: str, *, clustered: bool = True) -> tuple[Fit, float]:
    """Exact two-way fixed effects and the constant that goes with effects of mean zero: the grand means' residual."""
    use = df.select(entity, time, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    fit = ols(use, y, xs, entity, time, exact=True, clustered=clustered)
    mean = use.agg(*[F.avg(c).alias(c) for c in (y, *xs)]).first()
    return fit, mean[y] - sum(b * mean[x] for b, x in zip(fit.coef, xs, strict=True))


def placebo(df: DataFrame, columns: Sequence[str], entity: str, time: str, seed: int) -> DataFrame:
    """Each column's values permuted among the entities of a time, independently, nulls too."""
    df = stored(df)
    big = big_groups(df, [time])
    out = numbered(df, [time], [F.col(entity)], "_k", big=big)
    for c in columns:
        there = [F.xxhash64(F.lit(seed), F.lit(c), F.col(entity).cast("string")), F.col(entity)]
        source = numbered(df.select(entity, time, c), [time], there, "_j", big=big).select(F.col(time).alias("_t"), F.col(c).alias("_v"), "_j")
        out = out.join(source, out[time].eqNullSafe(source["_t"]) & (F.col("_k") == F.col("_j"))).withColumn(c, F.col("_v")).select(*df.columns, "_k")
    return out.drop("_k")


def specification(df: DataFrame, y: str, x: str, controls: Sequence[str], entity: str, time: str, *, lag: int = 1, effects: bool = True, placebo_seed: int | None = None, min_rows: int = 5) -> Fit:
    """One model: lagged regressors, or permuted ones."""
    regress = [x, *controls]
    moved = shifted(df, regress, entity, time, lag) if lag else df
    names = [f"{c}_lag{lag}" for c in regress] if lag else regress
    if placebo_seed is not None:
        moved = placebo(moved, names, entity, time, placebo_seed)
    return ols(moved, y, names, entity, time, entity_effects=effects, time_effects=effects)


def weight_draws(df: DataFrame, time: str, domains: Sequence[str], draws: int, seed: int) -> DataFrame:
    """(time, draw, w_<domain>): uniform Dirichlet weights, fresh for each time, from hashes and so the same in every run."""
    base = df.select(time).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    e = {d: -F.log((F.pmod(F.xxhash64(F.lit(seed), F.col(time).cast("string"), F.col("draw"), F.lit(d)), F.lit(1 << 53)).cast("double") + 1.0) / F.lit(float((1 << 53) + 1))) for d in domains}
    total = sum(e.values(), F.lit(0.0))
    return base.select(time, "draw", *[(e[d] / total).alias(f"w_{d}") for d in domains])


def rank_stability(df: DataFrame, domains: Sequence[str], entity: str, time: str, *, draws: int = 250, top: int = 20, seed: int = 42) -> DataFrame:
    """(entity, time, mean_rank, sd_rank, top_share) over draws of domain weights; ranks are within time and draw."""
    df = stored(df.select(entity, time, *domains))
    joined = df.join(weight_draws(df, time, domains, draws, seed), time)
    num = sum((F.coalesce(F.col(d), F.lit(0.0)) * F.col(f"w_{d}") for d in domains), F.lit(0.0))
    den = sum((F.when(F.col(d).isNotNull(), F.col(f"w_{d}")).otherwise(0.0) for d in domains), F.lit(0.0))
    scored = joined.withColumn("_s", F.try_divide(num, F.when(den > 0, den)))
    ranked = average_ranks(scored, "_s", "_r", [time, "draw"], big=_of_draws(big_groups(df, [time]), draws)).filter("_r IS NOT NULL")
    return ranked.groupBy(entity, time).agg(F.avg("_r").alias("mean_rank"), F.coalesce(F.stddev_samp("_r"), F.lit(0.0)).alias("sd_rank"), F.avg((F.col("_r") <= top).cast("double")).alias("top_share"))


def _of_draws(big, draws: int):
    """Groups that are big in each draw."""
    return big and (big[0], big[1] * draws)


def method_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str, by: Sequence[str], min_n: int = 5) -> DataFrame:
    """Spearman correlation of two methods' scores by group."""
    return spearman(a.select(*keys, F.col(x).alias("_a")).join(b.select(*keys, F.col(y).alias("_b")), list(keys)).withColumnsRenamed({"_a": "x", "_b": "y"}), "x", "y", by, min_n)


def event_study(df: DataFrame, treated: str, time: str, outcome: str, event: str, window: int, subgroups: Sequence[str] = ()) -> DataFrame:
    """(relative_day, control, treated): mean outcomes about an event; with subgroups, means of their means."""
    rel = df.withColumn("relative_day", F.datediff(F.col(time), F.lit(event).cast("date"))).filter(F.col("relative_day").between(-window, window))
    if subgroups:
        rel = rel.groupBy(*subgroups, treated, "relative_day").agg(F.avg(outcome).alias(outcome))
    return rel.groupBy("relative_day").agg(F.avg(F.when(~F.col(treated), F.col(outcome))).alias("control"), F.avg(F.when(F.col(treated), F.col(outcome))).alias("treated"))
