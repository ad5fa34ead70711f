"""Views of scored panels and of live surveys: what a dashboard shows, as frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweft.functions.order import big_groups, numbered, quantiles
from panelweft.functions.stats import _back
from panelweft.session import stored


def kpis(df: DataFrame, entity: str, time: str, score: str) -> DataFrame:
    """(time, mean_score, n_entities, best, worst, delta): a row a time; delta is to the time before by one, null if there is none."""
    y = df.groupBy(time).agg(F.avg(score).alias("mean_score"), F.count_distinct(entity).alias("n_entities"), F.max_by(entity, F.struct(F.col(score), F.col(entity))).alias("best"), F.min_by(entity, F.when(F.col(score).isNotNull(), F.struct(F.col(score), F.col(entity)))).alias("worst"))
    before = y.select((F.col(time) + 1).alias(time), F.col("mean_score").alias("_before"))
    return y.join(before, time, "left").withColumn("delta", F.col("mean_score") - F.col("_before")).drop("_before")


def ranking(df: DataFrame, entity: str, time: str, score: str, at) -> DataFrame:
    """Entities of one time from the best score to the worst."""
    return df.filter(F.col(time) == at).select(entity, score).orderBy(F.col(score).desc_nulls_last(), entity)


def trends(df: DataFrame, entity: str, time: str, score: str, entities: Sequence) -> DataFrame:
    """Known scores of the chosen entities."""
    return df.filter(F.col(entity).isin(list(entities)) & F.col(score).isNotNull() & F.col(time).isNotNull()).select(entity, time, score)


def heat_map(df: DataFrame, entity: str, time: str, domains: Sequence[str], at) -> DataFrame:
    """An entity a row, the domains that df has as columns."""
    return df.filter((F.col(time) == at) & F.col(entity).isNotNull()).select(entity, *[d for d in domains if d in df.columns])


def profile(df: DataFrame, entity: str, time: str, domains: Sequence[str], who, at) -> DataFrame:
    """(domain, score) of one entity at one time, without unknown scores."""
    return df.filter((F.col(time) == at) & (F.col(entity) == who)).select(*[F.col(d).cast("double").alias(d) for d in domains]).unpivot([], list(domains), "domain", "score").filter("score IS NOT NULL")


def coverage_view(df: DataFrame, time: str, *, ratio: str = "coverage_share", observed: str = "observed_indicator_points", imputed: str = "imputed_indicator_points", tier: str = "model_trust_tier") -> DataFrame:
    """(time, mean_coverage_pct, median_observed, median_imputed, high_trust_pct)."""
    df = stored(df.select(*dict.fromkeys([time, ratio, observed, imputed, tier])))
    means = df.groupBy(time).agg((F.avg(ratio) * 100).alias("mean_coverage_pct"), (F.avg(F.coalesce(F.col(tier) == "High", F.lit(False)).cast("double")) * 100).alias("high_trust_pct"))
    middle = quantiles(df, [observed, imputed], [0.5], [time], kept=True).withColumnsRenamed({"q0_0": "median_observed", "q1_0": "median_imputed"})
    return _back(means, middle, [time]).select(time, "mean_coverage_pct", "median_observed", "median_imputed", "high_trust_pct")


def significant_terms(models: DataFrame, p: str = "p_value", limit: float = 0.05) -> DataFrame:
    """Terms below the limit, the surest first."""
    return models.filter(F.col(p) < limit).orderBy(p)


def spread(df: DataFrame, entity: str, score: str, top: int = 20) -> DataFrame:
    """(entity, mean_score, lowest, highest, spread): entities whose scores move most."""
    return df.groupBy(entity).agg(F.avg(score).alias("mean_score"), F.min(score).alias("lowest"), F.max(score).alias("highest")).withColumn("spread", F.col("highest") - F.col("lowest")).orderBy(F.col("spread").desc_nulls_last(), entity).limit(top)


def marker_map(df: DataFrame, places: DataFrame, entity: str, time: str, score: str, at, least: float = 0.05) -> DataFrame:
    """(entity, lat, lon, score, size) of one time's entities that have a place; sizes are scores above the smallest."""
    here = df.filter((F.col(time) == at) & F.col(score).isNotNull()).join(places.select(entity, "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL"), entity)
    return _back(here, here.agg(F.min(score).alias("_m")), []).select(entity, "lat", "lon", score, (F.col(score) - F.col("_m") + least).alias("size"))


def latest(events: DataFrame, time: str, order: Sequence[str], top: int = 30) -> DataFrame:
    """The last rows by time, equals by order."""
    return events.orderBy(F.col(time).desc_nulls_last(), *order).limit(top)


def monitor(tables: dict[str, DataFrame], status: tuple[str, str], eligible: tuple[str, str]) -> DataFrame:
    """(measure, value, n): rows of each table, of each status, and eligible ones; status and eligible name a table and a column."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("measure"), F.lit(name).alias("value"), "n")
        out = n if out is None else out.unionByName(n)
    by = tables[status[0]].groupBy(F.col(status[1]).alias("value")).agg(F.count("*").alias("n")).select(F.lit("status").alias("measure"), "value", "n")
    ok = tables[eligible[0]].agg(F.count_if(F.col(eligible[1]).cast("boolean")).alias("n")).select(F.lit("eligible").alias("measure"), F.lit(None).cast("string").alias("value"), "n")
    return out.unionByName(by).unionByName(ok)


def chart_series(df: DataFrame, x: str, y: str, series: str) -> DataFrame:
    """(series, x, y): one array of points for each series, in order: chart data; a series has as many points as x has values."""
    return df.filter(F.col(y).isNotNull()).groupBy(F.col(series).alias("series")).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("p")).select("series", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def running_rank(df: DataFrame, time: str, entity: str, score: str) -> DataFrame:
    """(entity, time, rank, moved): places within times, and how many were gained since the entity's time before."""
    df = stored(df.select(entity, time, score))
    ranked = numbered(df, [time], [F.col(score).desc_nulls_last(), F.col(entity)], "rank", big=big_groups(df, [time])).select(entity, time, "rank")
    return ranked.withColumn("moved", F.lag("rank").over(Window.partitionBy(entity).orderBy(time)) - F.col("rank"))
