"""Indicator statistics, gates, selection and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.exprs import classify_domain
from panelweft.functions.stats import complete, inflations, mask_moments
from panelweft.operators.panel import coverage, pivot_mean

#: The order in which domains are listed.
DOMAINS = ("ACC", "SKL", "SRV", "AGR", "ECO", "OUT")


def indicator_stats(long: DataFrame, observed: DataFrame, *, entity: str = "economy", time: str = "year") -> DataFrame:
    """One row an indicator: coverage, imputation share, domain, ranking score.

    long: indicator_code, indicator_name, pillar, entity, time, value, was_imputed;
    observed: indicator_code, pct_observed.
    """
    base = long.groupBy("indicator_code").agg(F.min("indicator_name").alias("indicator_name"), F.min("pillar").alias("pillar"), F.count_distinct(time).alias("years_covered"), F.count_distinct(entity).alias("economies_covered"), F.avg(F.col("was_imputed").cast("double")).alias("imputation_share"))
    out = base.join(observed.select("indicator_code", F.col("pct_observed").alias("pct_observed_global")), "indicator_code", "left").join(coverage(long, [entity, time], "indicator_code", "value"), "indicator_code", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    score = zero("pct_observed_global") + 100.0 * zero("panel_coverage") + 0.25 * F.col("years_covered") + 0.10 * F.col("economies_covered") - 50.0 * zero("imputation_share")
    return out.withColumn("domain", classify_domain("indicator_name", "indicator_code", "pillar")).withColumn("ranking_score", score)


def gated(stats: DataFrame, *, min_pct_observed: float = 70.0, max_imputation_share: float = 0.35, min_years: int = 5, min_panel_coverage: float = 0.40) -> DataFrame:
    """stats with gate_pass."""
    ok = (F.coalesce("pct_observed_global", F.lit(0.0)) >= min_pct_observed) & (F.coalesce("imputation_share", F.lit(0.0)) <= max_imputation_share) & (F.col("years_covered") >= min_years) & (F.coalesce("panel_coverage", F.lit(0.0)) >= min_panel_coverage)
    return stats.withColumn("gate_pass", ok)


def picked(stats: DataFrame, *, min_per_domain: int = 4, max_per_domain: int = 8) -> DataFrame:
    """Of each domain its best indicators: those that pass, at most max, made up to min with the best of the rest."""
    passed = stats.groupBy("domain").agg(F.count_if("gate_pass").alias("_p"))
    w = Window.partitionBy("domain").orderBy(F.col("gate_pass").desc(), F.col("ranking_score").desc(), "indicator_code")
    n = F.greatest(F.least(F.col("_p"), F.lit(max_per_domain)), F.lit(min_per_domain))
    return stats.join(passed, "domain").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n", "_p")


#: Indicators of a domain up to which their masks are counted: 2 to that power of them at most.
MASKED = 16


def pruned(long: DataFrame, domains: dict[str, list[str]], scores: dict[str, float], *, max_corr: float = 0.90, max_vif: float = 10.0, min_keep: int = 1, keys: tuple[str, ...] = ("economy", "year")) -> dict[str, list[str]]:
    """Of each domain its codes (best first) without those that repeat a better one or that the others explain.

    Of two that correlate, over the rows that have both, the one of the lower score goes (the
    later one of equals); then the one of greatest variance inflation, over the rows that have
    all that are left, as long as it is above max_vif.  All sums of all domains come from one
    job, by masks of what a row has, so no elimination needs another; the choice among a
    domain's few codes is the driver's.
    """
    wide = {d: cs for d, cs in domains.items() if len(cs) > MASKED}
    if wide:
        raise ValueError(f"more than {MASKED} indicators in {sorted(wide)}; pick fewer first")
    several = {d: cs for d, cs in domains.items() if len(cs) > 1}
    codes = list(dict.fromkeys(c for cs in several.values() for c in cs))
    got = mask_moments(pivot_mean(long.filter(F.col("indicator_code").isin(codes)), list(keys), "indicator_code", "value", codes), several) if several else {}
    out = {d: list(cs) for d, cs in domains.items()}
    for d, cs in several.items():
        gone: set[str] = set()
        for i, a in enumerate(cs):
            for j in range(i + 1, len(cs)):
                b = cs[j]
                if a in gone or b in gone:
                    continue
                n, cross = complete(got[d], [i, j])
                size = (cross[0, 0] * cross[1, 1]) ** 0.5
                if n > 1 and size > 0 and abs(cross[0, 1] / size) >= max_corr:
                    gone.add(b if scores.get(a, 0.0) >= scores.get(b, 0.0) else a)
        kept = [c for c in cs if c not in gone]
        while len(kept) > max(min_keep, 2):
            n, cross = complete(got[d], [cs.index(c) for c in kept])
            if n < 10 or (cross.diagonal() <= 0).any():  # too few rows, or one that doesn't vary: nothing is known
                break
            found = inflations(cross)
            if max(found) <= max_vif:
                break
            kept.pop(found.index(max(found)))
        out[d] = kept
    return out


def selected(long: DataFrame, stats: DataFrame, **options) -> tuple[dict[str, list[str]], DataFrame]:
    """The indicators of each domain, and stats with role: core_formative, context_only or exclude."""
    g = gated(stats, **{k: v for k, v in options.items() if k in ("min_pct_observed", "max_imputation_share", "min_years", "min_panel_coverage")})
    rows = picked(g, **{k: v for k, v in options.items() if k in ("min_per_domain", "max_per_domain")}).select("domain", "indicator_code", "gate_pass", "ranking_score").collect()
    rows = sorted(rows, key=lambda r: (not r["gate_pass"], -r["ranking_score"], r["indicator_code"]))
    mine = {d: [r["indicator_code"] for r in rows if r["domain"] == d] for d in DOMAINS}
    out = pruned(long, {d: cs for d, cs in mine.items() if cs}, {r["indicator_code"]: r["ranking_score"] for r in rows}, **{k: v for k, v in options.items() if k in ("max_corr", "max_vif", "min_keep", "keys")})
    core = [c for cs in out.values() for c in cs]
    return out, g.withColumn("role", F.when(F.col("indicator_code").isin(core), "core_formative").when(F.col("gate_pass"), "context_only").otherwise("exclude"))

