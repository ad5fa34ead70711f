"""Data verification: each check is one aggregate, and a suite's checks share one pass."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelweft.functions.exprs import row_count, to_number
from panelweft.functions.order import quantiles
from panelweft.functions.stats import _back, corr_pairs

#: Indicators between 0 and 100, and indicators that are never negative.
PERCENTAGES = (
    "pop_hh_elec", "fem_literacy", "pop_hh_sf", "fem_15_24_hyg_period", "prop_hh_microfin", "prop_saving",
    "ACC_pop_hh_elec", "SKL_fem_literacy", "SRV_pop_hh_sf", "AGR_fem_15_24_hyg_period", "ECO_prop_hh_microfin",
    "OUT_prop_saving", "pct_observed_global", "imputation_share", "panel_coverage",
)
NON_NEGATIVE = (
    "hh_income_monthly", "OUT_hh_income_monthly", "AGR_shg_member_scale", "ECO_shg_credit_scale", "total_vol", "total_val",
    "p2p_vol", "p2m_vol", "no_of_transactions", "amt_of_transactions", "active_users", "NAT_upi_total_vol", "NAT_upi_total_val",
    "NAT_upi_p2p_vol", "NAT_upi_p2m_vol", "NAT_ib_no_of_transactions", "NAT_ib_amt_of_transactions", "NAT_ib_active_users",
    "n_obs", "n_entities", "n_years", "years_covered", "economies_covered",
)


#: The columns of domain scores.
DOMAIN_SCORES = ("ACC_score", "SKL_score", "SRV_score", "AGR_score", "ECO_score", "OUT_score")


@dataclass
class Result:
    """What a run of checks found."""

    dataset: str
    issues: list[dict] = field(default_factory=list)
    checks_run: int = 0
    checks_passed: int = 0

    def add(self, check: str, ok: bool | None, severity: str, message: str = "", **details) -> None:
        """ok None: the check could not be made, and counts neither way."""
        if ok is None:
            return
        self.checks_run += 1
        if ok:
            self.checks_passed += 1
        else:
            self.issues.append({"check": check, "severity": severity, "message": message, "details": details})

    @property
    def has_errors(self) -> bool:
        return any(i["severity"] == "error" for i in self.issues)

    def to_json(self) -> str:
        count = lambda s: sum(i["severity"] == s for i in self.issues)
        return json.dumps({"dataset": self.dataset, "checks_run": self.checks_run, "checks_passed": self.checks_passed, "errors": count("error"), "warnings": count("warning"), "infos": count("info"), "passed": not self.has_errors, "issues": self.issues}, default=str)


def null_report(df: DataFrame, columns: Sequence[str], limit: float = 0.20) -> DataFrame:
    """(column, n_rows, n_null, null_rate, severity): ok, warning below the limit, else error."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rate = F.coalesce(F.try_divide(F.col("n_null").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0))
    return one.unpivot(["n_rows"], list(columns), "column", "n_null").select("column", "n_rows", "n_null", rate.alias("null_rate")).withColumn("severity", F.when(F.col("n_null") == 0, "ok").when(F.col("null_rate") < limit, "warning").otherwise("error"))


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def without_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def range_report(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, n_low, n_high): values beyond the bounds."""
    agg = []
    for c, (lo, hi) in bounds.items():
        agg += [F.count_if(F.col(c) < lo if lo is not None else F.lit(False)).alias(f"{c}|lo"), F.count_if(F.col(c) > hi if hi is not None else F.lit(False)).alias(f"{c}|hi")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|lo`").alias("n_low"), F.col(f"`{c}|hi`").alias("n_high")) for c in bounds])
    return df.agg(*agg).select(F.explode(rows).alias("r")).select("r.*")


def clamped(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values brought to the bounds; null stays null."""
    def one(c, lo, hi):
        x = F.col(c)
        x = F.greatest(x, F.lit(float(lo))) if lo is not None else x
        x = F.least(x, F.lit(float(hi))) if hi is not None else x
        return F.when(F.col(c).isNotNull(), x)

    return df.withColumns({c: one(c, *b) for c, b in bounds.items() if c in df.columns})


def known_bounds(columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    return {c: (0.0, 100.0) for c in columns if c in PERCENTAGES} | {c: (0.0, None) for c in columns if c in NON_NEGATIVE}


def outlier_report(df: DataFrame, columns: Sequence[str], k: float = 3.0, min_n: int = 10) -> DataFrame:
    """(column, n, lo, hi, n_out): values beyond k interquartile ranges; columns with too few values or no range are left out."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    q = quantiles(rows, columns, [0.25, 0.75])
    fence = {c: (F.col(f"q{j}_0") - k * (F.col(f"q{j}_1") - F.col(f"q{j}_0")), F.col(f"q{j}_1") + k * (F.col(f"q{j}_1") - F.col(f"q{j}_0"))) for j, c in enumerate(columns)}
    at = {c: (F.max(lo), F.max(hi)) for c, (lo, hi) in fence.items()}  # the fences are one row's
    found = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), at[c][0].alias("lo"), at[c][1].alias("hi"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("n_out")) for c, (lo, hi) in fence.items()]
    return rows.crossJoin(F.broadcast(q)).agg(F.array(*found).alias("r")).select(F.inline("r")).filter((F.col("n") >= min_n) & (F.col("hi") > F.col("lo")))


def extreme_z(df: DataFrame, columns: Sequence[str], limit: float = 5.0) -> DataFrame:
    return df.agg(*[F.count_if(F.abs(F.col(c)) > limit).alias(c) for c in columns]).unpivot([], list(columns), "column", "n_extreme")


def coverage_report(df: DataFrame, time: str, first: int, last: int) -> DataFrame:
    """(lo, hi, n_times, n_out): the span of a time column and the rows beyond bounds."""
    return df.agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count_distinct(time).alias("n_times"), F.count_if((F.col(time) < first) | (F.col(time) > last)).alias("n_out"))


def balance_report(df: DataFrame, entity: str, time: str) -> DataFrame:
    """(n_entities, n_times, n_cells, balance)."""
    one = df.filter(F.col(entity).isNotNull() & F.col(time).isNotNull()).agg(F.count_distinct(entity).alias("n_entities"), F.count_distinct(time).alias("n_times"), F.count_distinct(entity, time).alias("n_cells"))
    return one.withColumn("balance", F.try_divide(F.col("n_cells").cast("double"), (F.col("n_entities") * F.col("n_times")).cast("double")))


def coercion_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_lost): values that aren't numbers."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & to_number(c).isNull()).alias(c) for c in columns]).unpivot([], list(columns), "column", "n_lost")


def completeness_report(df: DataFrame, score: str, limit: float = 0.25) -> DataFrame:
    one = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(score).isNull()).alias("n_missing"))
    return one.withColumn("ok", F.coalesce(F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows").cast("double")), F.lit(1.0)) <= limit)


def domains_report(df: DataFrame, columns: Sequence[str], least: int) -> DataFrame:
    """(n_rows, n_short): rows with fewer than so many scores."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(row_count(columns) < least).alias("n_short"))


def key_sets(lines: DataFrame, column: str = "value") -> DataFrame:
    """(keys, n): the sets of keys that JSON lines have."""
    return lines.filter(F.trim(F.col(column)) != "").groupBy(F.array_join(F.sort_array(F.json_object_keys(column)), ",").alias("keys")).agg(F.count("*").alias("n"))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_observed, missing_rate)."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["n_rows"], list(columns), "column", "n_observed").withColumn("missing_rate", 1 - F.try_divide(F.col("n_observed").cast("double"), F.col("n_rows").cast("double")))


def correlation_report(long: DataFrame, code: str, keys: Sequence[str], value: str) -> DataFrame:
    """Pairs by strength."""
    return corr_pairs(long, code, keys, value).orderBy(F.abs("corr").desc_nulls_last(), "a", "b")


def verify(df: DataFrame, dataset: str, *, required: Sequence[str] = (), key: Sequence[str] = (), time: str | None = None, entity: str | None = None, years: tuple[int, int] | None = None, numeric: Sequence[str] = (), scores: Sequence[str] = (), min_rows: int = 1, min_domains: int = 0, min_balance: float = 0.3) -> Result:
    """The inline suite: one aggregate for all counts, one for outlier fences, one for duplicates."""
    out = Result(dataset)
    lost = [c for c in required if c not in df.columns]
    out.add("required_columns", not lost, "error", f"missing columns: {lost}", columns=lost)
    if lost:
        return out
    have = [c for c in numeric if c in df.columns]
    bounds = known_bounds(have)
    aggs = [F.count("*").alias("n")] + [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    for c, (lo, hi) in bounds.items():
        bad = (F.col(c) < lo) if hi is None else (F.col(c) < lo) | (F.col(c) > hi)
        aggs.append(F.count_if(bad).alias(f"range_{c}"))
    if time:
        aggs += [F.min(time).alias("t0"), F.max(time).alias("t1")]
    if time and entity:
        aggs += [F.count_distinct(entity).alias("ne"), F.count_distinct(time).alias("nt"), F.count_distinct(entity, time).alias("nc")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"score_{c}") for c in scores if c in df.columns]
    if min_domains:
        aggs.append(F.count_if(row_count([c for c in scores if c in df.columns]) < min_domains).alias("short"))
    r = df.agg(*aggs).first().asDict()
    n = r["n"]
    out.add("minimum_sample", n >= min_rows, "error", f"{n} rows, {min_rows} needed", n=n)
    for c in required:
        rate = r[f"null_{c}"] / n if n else 0.0
        out.add(f"nulls_{c}", rate == 0, "warning" if rate < 0.2 else "error", f"{rate:.1%} null", rate=rate)
    for c in bounds:
        out.add(f"range_{c}", r[f"range_{c}"] == 0, "warning", f"{r[f'range_{c}']} values out of range", n=r[f"range_{c}"])
    if key:
        d = duplicate_report(df, key).limit(5).collect()
        out.add("duplicates", not d, "warning", "duplicate keys", examples=[list(x) for x in d])
    if time and years:
        out.add("year_coverage", None if r["t0"] is None else years[0] <= r["t0"] and r["t1"] <= years[1], "warning", "years out of bounds", span=(r["t0"], r["t1"]))
    if time and entity and r["ne"]:
        balance = r["nc"] / (r["ne"] * r["nt"])
        out.add("panel_balance", balance >= min_balance, "warning", f"balance {balance:.2f}", balance=balance)
    for c in scores:
        if c in df.columns and n:
            out.add(f"completeness_{c}", r[f"score_{c}"] / n <= 0.25, "warning", "too many missing scores", n=r[f"score_{c}"])
    if min_domains:
        out.add("domain_coverage", r["short"] == 0, "warning", f"{r['short']} rows have too few domains", n=r["short"])
    if have:
        for x in outlier_report(df, have).collect():
            out.add(f"outliers_{x['column']}", x["n_out"] == 0, "info", f"{x['n_out']} outliers", n=x["n_out"])
    return out


def check_scores(df: DataFrame, *, entity: str, time: str, tier: str = "model_trust_tier", core_per_domain: dict[str, int] | None = None, min_high: float = 0.05) -> Result:
    """The suite for scored panels: tiers are known ones, enough are High, domains have enough indicators, the panel is balanced."""
    out = Result("scores")
    r = df.agg(F.count("*").alias("n"), F.avg((F.col(tier) == "High").cast("double")).alias("high"), F.collect_set(tier).alias("tiers"), F.count_distinct(entity, time).alias("cells"), F.count_distinct(entity).alias("e"), F.count_distinct(time).alias("t")).first()
    out.add("keys_unique", r["cells"] == r["n"], "error", "duplicate entity-time rows")
    out.add("tiers_known", set(r["tiers"]) <= {"High", "Medium", "Low"}, "error", "unknown tier", tiers=r["tiers"])
    out.add("high_share", (r["high"] or 0) >= min_high, "warning", f"High share {r['high']}")
    out.add("balance", bool(r["n"]) and r["cells"] / (r["e"] * r["t"]) >= 0.3, "warning", "unbalanced panel")
    for d, n in (core_per_domain or {}).items():
        out.add(f"core_{d}", n >= 2, "error", f"{d} has {n} core indicators")
    return out


def check_model(fit, placebo_fit=None, others: Sequence = (), *, stability: DataFrame | None = None) -> Result:
    """The suite for a causal panel."""
    out = Result("model")
    out.add("n_obs", fit.n >= 200, "error", f"{fit.n} observations")
    out.add("n_entities", fit.n_entities >= 25, "error", f"{fit.n_entities} entities")
    out.add("n_times", fit.n_times >= 8, "warning", f"{fit.n_times} times")
    out.add("df", fit.df_residual >= 30, "error", f"{fit.df_residual} degrees of freedom")
    out.add("f", fit.f >= 4, "warning", f"F = {fit.f}")
    out.add("durbin_watson", fit.durbin_watson is not None and 1 <= fit.durbin_watson <= 3, "warning", f"DW = {fit.durbin_watson}")
    out.add("r2", fit.r2 <= 0.95, "warning", f"R2 = {fit.r2}")
    if placebo_fit is not None:
        real, fake = fit.p[0], placebo_fit.p[0]
        vacuous = real is None or real >= 0.05
        out.add("placebo", True if vacuous else fake is None or fake > real, "warning", "the placebo is as strong as the model", vacuous=vacuous)
    if others:
        out.add("sign_stability", all(o.coef[0] * fit.coef[0] >= 0 for o in others), "warning", "the sign changes between specifications")
    if stability is not None:
        flat = stability.agg(F.avg((F.col("sd_rank") == 0).cast("double"))).first()[0]
        out.add("degenerate_sd", (flat or 0) < 0.5, "warning", f"{flat} of ranks never move")
    return out


def check_state(df: DataFrame, *, entity: str = "state_name", time: str = "year", score: str = "composite_score", adjusted: str = "composite_context_adjusted", domains: Sequence[str] = DOMAIN_SCORES, min_domains: int = 3) -> Result:
    """The suite for the state track: keys, scores, fences of domain scores, extreme z-scores, known bounds, domains a row."""
    out = Result("state")
    lost = [c for c in (entity, time, score) if c not in df.columns]
    out.add("required_columns", not lost, "error", f"missing columns: {lost}", columns=lost)
    if lost:
        return out
    have = [c for c in domains if c in df.columns]
    zs = [c for c in df.columns if c.startswith("Z_")]
    bounds = known_bounds(df.columns)
    aggs = [F.count("*").alias("n"), F.count_distinct(F.struct(entity, time)).alias("cells"), F.count_if(F.col(score).isNull()).alias("no_score"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count_distinct(entity).alias("entities"), F.count_distinct(time).alias("times")]
    aggs += [F.count_if(F.col(adjusted).isNull()).alias("no_adjusted")] if adjusted in df.columns else []
    aggs += [F.count_if(F.abs(F.col(c)) > 5).alias(f"z|{c}") for c in zs]
    aggs += [F.count_if(F.col(c) < lo if hi is None else (F.col(c) < lo) | (F.col(c) > hi)).alias(f"b|{c}") for c, (lo, hi) in bounds.items()]
    aggs += [F.count_if(row_count(have) < min_domains).alias("sparse")] if have else []
    r = df.agg(*aggs).first().asDict()
    out.add("duplicate_keys", r["cells"] == r["n"], "error", f"{r['n'] - r['cells']} duplicates", n=r["n"] - r["cells"])
    out.add("null_score", r["no_score"] == 0, "error", f"{r['no_score']} rows without a score", n=r["no_score"])
    if adjusted in df.columns:
        out.add("null_adjusted_score", r["no_adjusted"] == 0, "error", f"{r['no_adjusted']} rows without", n=r["no_adjusted"])
    for x in outlier_report(df, have).collect() if have else []:
        out.add(f"outliers_{x['column']}", x["n_out"] == 0, "warning", f"{x['n_out']} outliers", n=x["n_out"])
    for c in zs:
        out.add(f"extreme_{c}", r[f"z|{c}"] == 0, "warning", f"{r[f'z|{c}']} beyond 5", n=r[f"z|{c}"])
    for c in bounds:
        out.add(f"range_{c}", r[f"b|{c}"] == 0, "warning", f"{r[f'b|{c}']} out of range", n=r[f"b|{c}"])
    if have:
        out.add("sparse_domains", r["sparse"] == 0, "warning", f"{r['sparse']} rows with fewer than {min_domains} domains", n=r["sparse"])
    out.add("rows", r["n"] > 0, "error", "no rows", n=r["n"], span=(r["t0"], r["t1"]), n_entities=r["entities"], n_times=r["times"])
    return out


def check_api(df: DataFrame, years: tuple[int, int], *, entity: str = "iso3c", time: str = "year", score: str = "composite_score", domains: Sequence[str] = DOMAIN_SCORES, tier: str = "model_trust_tier", min_rows: int = 100) -> Result:
    """The suite for the API track; Result.has_errors is what an exit code tells."""
    out = Result("api")
    lost = [c for c in (entity, time, score, tier) if c not in df.columns]
    out.add("required_columns", not lost, "error", f"missing columns: {lost}", columns=lost)
    if lost:
        return out
    r = df.agg(F.count("*").alias("n"), F.count_distinct(F.struct(entity, time)).alias("cells"), F.count_if(F.col(score).isNull()).alias("no_score"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.collect_set(F.when(F.col(tier).isin("High", "Medium", "Low"), "known").otherwise(F.col(tier))).alias("tiers")).first()
    out.add("duplicate_keys", r["cells"] == r["n"], "error", f"{r['n'] - r['cells']} duplicates")
    out.add("null_score", r["no_score"] == 0, "error", f"{r['no_score']} rows without a score")
    out.add("year_min", r["t0"] is None or r["t0"] >= years[0], "error", f"first year {r['t0']}")
    out.add("year_max", r["t1"] is None or r["t1"] <= years[1], "error", f"last year {r['t1']}")
    for c in domains:
        out.add(f"domain_{c}", c in df.columns, "error", f"no {c}")
    out.add("tiers_known", set(r["tiers"]) <= {"known"}, "error", "unknown tiers", tiers=sorted(set(r["tiers"]) - {"known"}))
    out.add("rows", r["n"] >= min_rows, "error", f"{r['n']} rows, {min_rows} needed")
    return out


def scan_reports(reports: DataFrame, wanted: Sequence[str] | DataFrame, *, name: str = "name", content: str = "content") -> DataFrame:
    """(report, section, issue, n) of verification reports, a JSON document a row: missing, invalid, or with errors in a section.

    A report is either one section (it has issues itself) or an object of sections.  wanted: names,
    or a table whose first column has them.
    """
    section = "struct<issues:array<struct<severity:string>>>"
    names = wanted.toDF(*["report", *wanted.columns[1:]]).select("report") if isinstance(wanted, DataFrame) else reports.sparkSession.createDataFrame([(w,) for w in wanted], "report string")
    read = names.join(reports.select(F.col(name).alias("report"), F.col(content).alias("_c")), "report", "left").withColumn("_m", F.from_json("_c", "map<string,string>"))
    valid = F.coalesce(F.col("_m").isNotNull() & F.startswith(F.ltrim("_c"), F.lit("{")) & F.expr("try_parse_json(_c) IS NOT NULL"), F.lit(False))
    bad = read.filter(~valid).select("report", F.lit(None).cast("string").alias("section"), F.when(F.col("_c").isNull(), "missing").otherwise("invalid").alias("issue"), F.lit(1).cast("long").alias("n"))
    good = read.filter(valid)
    parts = good.select("report", F.explode("_m").alias("section", "_s")).unionByName(good.select("report", F.lit("").alias("section"), F.col("_c").alias("_s"))).select("report", "section", F.from_json("_s", section).alias("s")).filter("s.issues IS NOT NULL")
    errors = parts.select("report", "section", F.lit("errors").alias("issue"), F.size(F.filter("s.issues", lambda i: i["severity"] == "error")).cast("long").alias("n")).filter("n > 0")
    return bad.unionByName(errors)


#: Distributions whose versions a manifest has, if they are installed.
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy", "PyYAML", "pyahocorasick")


def _version(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


class Audit:
    """A run's manifest: configuration hash, seeds, inputs, row accounting, outputs."""

    def __init__(self, pipeline: str, config: dict | None = None, seeds: dict | None = None, commit: str | None = None, packages: Sequence[str] = PACKAGES) -> None:
        text = json.dumps(config or {}, sort_keys=True, default=str)
        self.manifest: dict = {"pipeline": pipeline, "run_id": hashlib.sha256(f"{pipeline}{self._now()}".encode()).hexdigest()[:16], "started_at_utc": self._now(), "environment": {"python_version": platform.python_version(), "platform": platform.platform(), "packages": {p: v for p in packages if (v := _version(p))}}, "config_snapshot": config or {}, "git_commit": commit, "config_sha256": hashlib.sha256(text.encode()).hexdigest(), "random_seeds": seeds or {}, "inputs": [], "parameters": {}, "stages": [], "outputs": [], "status": "running"}

    @staticmethod
    def _now() -> str:
        return datetime.now(timezone.utc).isoformat()

    def record_input(self, name: str, files: DataFrame) -> None:
        """files: sources.readers.digests(); a row a file."""
        for r in files.select("path", "sha256", "length").collect():
            self.manifest["inputs"].append({"name": name, "path": r["path"], "exists": True, "sha256": r["sha256"], "size_bytes": r["length"]})

    @contextmanager
    def observe(self, stage: str, df: DataFrame):
        """Rows of df (as a stage's output) counted while its own action runs: no second pass."""
        seen = Observation(stage)
        yield df.observe(seen, F.count(F.lit(1)).alias("n"))
        n = seen.get["n"]
        self.record_stage(stage, n, n)

    def record_stage(self, stage: str, rows_in: int, rows_out: int, rows_dropped: int = 0, **more) -> None:
        row = {"stage": stage, "timestamp_utc": self._now(), "rows_in": rows_in, "rows_out": rows_out, "rows_dropped": rows_dropped} | more
        if rows_in != rows_out + rows_dropped:
            row["accounting_warning"] = f"{rows_in} != {rows_out} + {rows_dropped}"
        self.manifest["stages"].append(row)

    def filtered(self, stage: str, df: DataFrame, drops: dict[str, Column]) -> DataFrame:
        """df without the rows for which a reason's condition is true; rows count for their first reason, all in one aggregate."""
        reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in drops.items()], F.lit(""))
        marked = df.withColumn("_drop", reason)
        n = {r["_drop"]: r["n"] for r in marked.groupBy("_drop").agg(F.count("*").alias("n")).collect()}
        kept, lost = n.pop("", 0), {name: n[name] for name in drops if name in n}
        self.record_stage(stage, kept + sum(lost.values()), kept, sum(lost.values()), **({"drop_reasons": lost} if lost else {}))
        return marked.filter("_drop = ''").drop("_drop")

    def record_parameter(self, name: str, value) -> None:
        self.manifest["parameters"][name] = value

    def record_output(self, name: str, path: str, rows: int) -> None:
        self.manifest["outputs"].append({"name": name, "path": path, "rows": rows})

    def complete(self, status: str = "success") -> str:
        self.manifest |= {"completed_at_utc": self._now(), "status": status}
        return json.dumps(self.manifest, default=str)


def check_manifest(text: str) -> Result:
    """The suite for a manifest: fields, checksums, accounting, status."""
    out = Result("manifest")
    try:
        m = json.loads(text)
    except ValueError:
        out.add("json", False, "error", "not JSON")
        return out
    for f in ("pipeline", "run_id", "started_at_utc", "environment", "inputs", "stages", "outputs", "status"):
        out.add(f"field_{f}", f in m, "error", f"no {f}")
    out.add("git_commit", bool(m.get("git_commit")), "warning", "no commit")
    out.add("checksums", all(i.get("sha256") for i in m.get("inputs", []) if i.get("exists")), "warning", "an input has no checksum")
    out.add("accounting", not any("accounting_warning" in s for s in m.get("stages", [])), "warning", "rows don't add up")
    out.add("status", m.get("status") == "success", "error", f"status {m.get('status')}")
    return out
