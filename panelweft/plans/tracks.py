"""The pipelines: state-year, country-year, API and news tracks, each one lazy plan from typed inputs to its results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.functions.exprs import oriented, replaced, row_count, row_mean, to_bool, to_number, trust_tier, weighted_mean, year_of_period
from panelweft.functions.stats import _back, tukey_clip, winsor_zscore, winsor_zscores
from panelweft.operators import text
from panelweft.operators.gating import DOMAINS, indicator_stats, selected
from panelweft.operators.panel import group_mean, group_sum, impute, interpolate, nearest, outer_mean, pivot_mean, with_fallback
from panelweft.operators.verify import clamped, known_bounds

#: Territories under their present name, and the domain of each state indicator.
TERRITORIES = {"Dadra & Nagar Haveli": "Dadra and Nagar Haveli and Daman and Diu", "Daman & Diu": "Dadra and Nagar Haveli and Daman and Diu"}
STATE_DOMAINS = {
    "ACC": ("ACC_pop_hh_elec",), "SKL": ("SKL_fem_literacy",), "SRV": ("SRV_pop_hh_sf",), "AGR": ("AGR_fem_15_24_hyg_period", "AGR_shg_member_scale"),
    "ECO": ("ECO_prop_hh_microfin", "ECO_shg_credit_scale"), "OUT": ("OUT_hh_income_monthly", "OUT_prop_saving"),
}


def survey_means(raw: DataFrame, metrics: dict[str, str], *, state: str = "state_name", period: str = "year", recode: dict[str, str] = TERRITORIES) -> DataFrame:
    """(state_name, year, metrics): a survey extract by state and year, percentages clamped; null states and years are dropped."""
    typed = raw.select(replaced(F.trim(F.col(state)), recode).alias("state_name"), year_of_period(period).alias("year"), *[to_number(k).alias(k) for k in metrics])
    rows = clamped(typed, known_bounds(list(metrics))).filter("state_name IS NOT NULL AND year IS NOT NULL")
    return group_mean(rows, ["state_name", "year"], list(metrics)).withColumnsRenamed(metrics)


def national_sums(raw: DataFrame, metrics: dict[str, str], *, period: str = "month") -> DataFrame:
    """(year, metrics): national series by year; a year of nulls sums to 0."""
    typed = raw.select(year_of_period(period).alias("year"), *[to_number(k).alias(k) for k in metrics]).filter("year IS NOT NULL")
    return group_sum(typed, ["year"], list(metrics)).withColumnsRenamed(metrics)


def group_totals(raw: DataFrame, state: str, year: str | None, metrics: dict[str, str]) -> DataFrame:
    """(state_name, year, metrics): the large extract, by partial and final aggregation; year is null where there is no such column."""
    y = year_of_period(year) if year else F.lit(None).cast("int")
    typed = raw.select(F.trim(F.col(state)).alias("state_name"), y.alias("year"), *[to_number(k).alias(v) for k, v in metrics.items()]).filter("state_name IS NOT NULL")
    return group_sum(typed, ["state_name", "year"], list(metrics.values()))


def state_year(nafis: DataFrame, nfhs: DataFrame, national: dict[str, DataFrame], shg: DataFrame | None, context: DataFrame | None = None, *, alpha: float = 0.15) -> DataFrame:
    """Scores by state and year."""
    panel = outer_mean(nafis, nfhs, ["state_name", "year"])
    for df in national.values():
        panel = nearest(panel, df, "year", [c for c in df.columns if c != "year"])
    if shg is not None:
        cols = [c for c in shg.columns if c not in ("state_name", "year")]
        panel = panel.join(shg, (panel["state_name"] == shg["state_name"]) & panel["year"].eqNullSafe(shg["year"]), "left").drop(shg["state_name"], shg["year"])
        panel = with_fallback(panel, group_sum(shg, ["state_name"], cols), ["state_name"], cols)
    codes = [c for cs in STATE_DOMAINS.values() for c in cs if c in panel.columns]
    panel = impute(interpolate(panel, codes, "state_name", "year"), codes, "year")
    return scored(panel, {d: [c for c in cs if c in codes] for d, cs in STATE_DOMAINS.items()}, context, alpha=alpha)


def scored(panel: DataFrame, domains: dict[str, Sequence[str]], context: DataFrame | None = None, *, alpha: float = 0.15) -> DataFrame:
    """Z-scores, domain scores, composite, and the composite adjusted by a national context (year, value)."""
    panel = winsor_zscores(panel, {c: f"Z_{c}" for cs in domains.values() for c in cs})
    have = {d: cs for d, cs in domains.items() if cs}
    panel = panel.withColumns({f"{d}_score": row_mean([f"Z_{c}" for c in cs]) for d, cs in have.items()})
    panel = panel.withColumn("composite_score", row_mean([f"{d}_score" for d in have]))
    if context is not None:
        joined = panel.join(context.select("year", F.col("value").alias("CTX_value")), "year", "left")
        panel = winsor_zscore(joined, "CTX_value", "Z_CTX_value").withColumn("composite_context_adjusted", F.col("composite_score") + alpha * F.col("Z_CTX_value"))
    return panel


def country_year(long: DataFrame, mapping: DataFrame, observed: DataFrame, *, years: tuple[int, int] = (2014, 2025), high: int = 4, medium: int = 3, **options) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Scores by economy and year, the intake table, and the selected indicators. Two round trips: selection and nothing else."""
    name = next((c for c in ("indicator_name", "indicator_name.y", "indicator_name.x") if c in long.columns), None)
    meta = mapping.groupBy("indicator_code").agg(F.min(F.struct("indicator_name", "pillar")).alias("_m")).select("indicator_code", "_m.*").select("indicator_code", F.col("indicator_name").alias("_name"), F.col("pillar").alias("_pillar"))
    use = long.filter(F.lower(F.trim("include_v2")) == "yes") if "include_v2" in long.columns else long
    rows = use.withColumn("_n", F.col(f"`{name}`") if name else F.lit(None).cast("string")).withColumn("_p", F.col("pillar") if "pillar" in long.columns else F.lit(None).cast("string")).join(meta, "indicator_code", "left")
    rows = rows.select("indicator_code", F.coalesce("_n", "_name", "indicator_code").alias("indicator_name"), F.coalesce("_p", "_pillar").alias("pillar"), "economy", F.col("year").cast("int").alias("year"), to_number("norm_score").alias("value"), to_bool("was_imputed").alias("was_imputed")).filter(F.col("year").between(*years))
    chosen, intake = selected(rows, indicator_stats(rows, observed), **options)
    codes = [c for cs in chosen.values() for c in cs]
    if not codes:
        raise ValueError("no indicator was selected")
    wide = pivot_mean(rows.filter(F.col("indicator_code").isin(codes) & F.col("value").isNotNull()), ["economy", "year"], "indicator_code", "value", codes)
    before = {f"n_observed_{d}": row_count(cs) for d, cs in chosen.items()}
    panel = impute(wide.withColumns(before), codes, "year")
    weights = {r["domain"]: max(0.05, r["w"] or 0.0) for r in intake.filter(F.col("indicator_code").isin(codes)).groupBy("domain").agg(F.avg("panel_coverage").alias("w")).collect()}
    panel = scored(panel, chosen)
    ds = [d for d in DOMAINS if d in chosen]
    panel = panel.withColumns({"n_domains_used": row_count([f"{d}_score" for d in ds]), "composite_confidence_weighted": weighted_mean([f"{d}_score" for d in ds], [weights.get(d, 1.0) for d in ds])})
    panel = tukey_clip(panel, ["composite_score", "composite_confidence_weighted"])
    return panel.withColumn("model_trust_tier", trust_tier("n_domains_used", high, medium)), intake, chosen


def api_year(long: DataFrame, countries: DataFrame, *, years: tuple[int, int] = (2014, 2025), min_indicators: int = 2, tiers: tuple[float, float] = (0.80, 0.60), pooled: bool = True) -> DataFrame:
    """Scores from an API's long table: orientation, z-scores within years (pooled over indicators, or of each), domain and composite scores, coverage tiers."""
    rows = long.filter(F.col("year").between(*years) & F.col("value").isNotNull()).select("indicator_code", "domain", "iso3c", "year", oriented("value", "direction").alias("value"))
    z = winsor_zscore(rows, "value", "z", ["year"] if pooled else ["indicator_code", "year"], ddof=0)
    catalogue = [(r["indicator_code"], r["domain"]) for r in long.select("indicator_code", "domain").distinct().orderBy("domain", "indicator_code").collect()]
    codes = [c for c, _ in catalogue]
    points = rows.groupBy("iso3c", "year").agg(F.count_distinct("indicator_code").alias("observed_indicator_points"))
    panel = impute(pivot_mean(z, ["iso3c", "year"], "indicator_code", "z", codes), codes, "year").join(points, ["iso3c", "year"], "left")
    by = {d: [c for c, x in catalogue if x == d] for d in DOMAINS if any(x == d for _, x in catalogue)}
    panel = panel.withColumns({f"{d}_score": F.when(row_count(cs) >= min(min_indicators, len(cs)), row_mean(cs)) for d, cs in by.items()})
    scores = [f"{d}_score" for d in by]
    panel = panel.withColumns({"composite_score": row_mean(scores), "n_domains_used": row_count(scores), "coverage_share": F.col("observed_indicator_points") / float(len(codes)), "composite_confidence_weighted": weighted_mean(scores, [row_count(cs) / float(len(cs)) for cs in by.values()])})
    panel = tukey_clip(panel, ["composite_score", "composite_confidence_weighted"]).withColumn("model_trust_tier", trust_tier("coverage_share", *tiers))
    return panel.join(countries, "iso3c")


def with_share(df: DataFrame, value: str, out: str) -> DataFrame:
    """A column's share of its total."""
    return _back(df, df.agg(F.sum(value).alias("_t")), []).withColumn(out, F.try_divide(F.col(value), F.col("_t"))).drop("_t")


def news(old: DataFrame | None, fetched: DataFrame, keywords: Sequence[tuple[str, str, str]], *, now, key: str = "article_id", published: str = "published_at", by: Sequence[str] = ("country_iso3",), days: int = 14) -> dict[str, DataFrame]:
    """A turn of the news agent: fetched articles mapped, merged into the intake, summed up.

    intake: the last of each key within the look-back (with no old intake, all fetched ones as they are);
    domains: (primary_domain, n); groups: (by, n, mapped, mapping_rate); totals: one row (n, mapped,
    mapping_rate), nulls and zeros of an empty turn included.  Write the intake before the next turn reads it.
    """
    mapped = text.map_articles(fetched, keywords)
    intake = mapped if old is None else text.rolling_intake(old, mapped, key=key, published=published, now=now, days=days)
    return {"intake": intake, "domains": intake.groupBy("primary_domain").agg(F.count("*").alias("n")), "groups": text.news_summary(intake, by), "totals": text.news_summary(intake, [])}
