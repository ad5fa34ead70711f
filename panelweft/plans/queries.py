"""The library's operators bound to the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.functions import exprs as X
from panelweft.functions import stats as S
from panelweft.functions.order import average_ranks, big_groups
from panelweft.operators import changes, econometrics, gating, panel, search_index, spatial, survey, text, verify
from panelweft.session import scratch
from panelweft.sources import readers
from panelweft.streaming import live, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _wide(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table for work that is long next to its reading."""
    return readers.parquet(spark, f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _round(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded for comparison; 0.0 is added so that there is no negative zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), own.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# The panel: nations by order year. Its gaps are fixed by keys: they are the same in every run.
def base(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"))
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("di"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("k"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(li, o.o_orderkey == li.l_orderkey)
    p = j.groupBy("entity", F.col("n_nationkey").alias("nk"), "yr").agg(F.count("*").alias("n_orders"), (F.sum("rev") / 1000.0).alias("revenue"), (F.sum("q") / F.sum("k")).alias("qty"), (F.sum("di") / F.sum("k")).alias("disc"), (F.sum("r") / F.sum("k")).alias("ret"))
    return p.withColumn("gap", F.when((F.col("nk") * 3 + F.col("yr")) % 4 != 0, F.col("qty")))


BASE = """
li AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_quantity) AS q, sum(l_discount) AS di, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) AS k FROM lineitem GROUP BY l_orderkey),
p0 AS (SELECT n_name AS entity, n_nationkey AS nk, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n_orders, sum(rev) / 1000.0e0 AS revenue, sum(q) / sum(k) AS qty, sum(di) / sum(k) AS disc, CAST(sum(r) AS DOUBLE) / CAST(sum(k) AS DOUBLE) AS ret
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN li ON o_orderkey = l_orderkey GROUP BY ALL),
p AS (SELECT *, CASE WHEN (nk * 3 + yr) % 4 <> 0 THEN qty END AS gap FROM p0)
"""
R = lambda e, k=6: f"round({e}, {k}) + 0.0e0"


def long(spark: SparkSession, d: str) -> DataFrame:
    """The panel's indicators, a row each: code, domain, direction, entity, yr, value."""
    p = base(spark, d)
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(dom).alias("domain"), F.lit(dr).alias("direction"), F.col(c).cast("double").alias("value")) for c, dom, dr in CODES])
    return p.select("entity", "nk", "yr", F.explode(rows).alias("r")).select("entity", "nk", "yr", "r.*")


CODES = (("n_orders", "ACC", "positive"), ("revenue", "ECO", "positive"), ("gap", "ECO", "positive"), ("disc", "OUT", "negative"), ("ret", "OUT", "negative"))
LONG = BASE + ", lg AS (" + " UNION ALL ".join(f"SELECT entity, nk, yr, '{c}' AS code, '{dom}' AS domain, '{dr}' AS direction, CAST({c} AS DOUBLE) AS value FROM p" for c, dom, dr in CODES) + ")"


def _z(src: str, col: str, by: str = "", sd: str = "stddev_samp") -> str:
    """SQL of a winsorised z-score over src, with columns of src and z."""
    on = f"USING ({by})" if by else "ON true"
    g = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    return f"""
b_ AS (SELECT {sel}quantile_cont({col}, 0.05e0) AS lo, quantile_cont({col}, 0.95e0) AS hi FROM {src} {g}),
w_ AS (SELECT {src}.*, CASE WHEN {col} IS NOT NULL THEN greatest(least({col}, hi), lo) END AS w FROM {src} LEFT JOIN b_ {on}),
m_ AS (SELECT {sel}avg(w) AS m, {sd}(w) AS s FROM w_ {g}),
z_ AS (SELECT w_.*, CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (w - m) / s END AS z FROM w_ LEFT JOIN m_ {on})"""


# Scores

@query(f"""WITH {LONG}, o_ AS (SELECT *, CASE WHEN direction = 'negative' THEN -value ELSE value END AS v FROM lg), {_z('o_', 'v', 'code')},
d_ AS (SELECT entity, yr, domain, avg(z) AS s FROM z_ GROUP BY ALL)
SELECT entity, yr, {R('max(s) FILTER (domain = $$ACC$$)')} AS "ACC", {R('max(s) FILTER (domain = $$ECO$$)')} AS "ECO", {R('max(s) FILTER (domain = $$OUT$$)')} AS "OUT", {R('avg(s)')} AS composite FROM d_ GROUP BY entity, yr""".replace("$$", "'"))
def composite_score(spark, d):
    """Oriented, winsorised, standardised indicators; domain means; their mean. The flagship."""
    rows = long(spark, d).withColumn("v", X.oriented("value", "direction"))
    z = S.winsor_zscore(rows, "v", "z", ["code"])
    wide = z.groupBy("entity", "yr").pivot("domain", ["ACC", "ECO", "OUT"]).agg(F.avg("z"))
    return _round(wide.withColumn("composite", X.row_mean(["ACC", "ECO", "OUT"])))


@query(f"WITH {LONG}, v_ AS (SELECT * FROM lg WHERE value IS NOT NULL), {_z('v_', 'value', 'yr', 'stddev_pop')} SELECT entity, yr, code, {R('z')} AS z FROM z_")
def zscore_within_year(spark, d):
    rows = long(spark, d).filter("value IS NOT NULL")
    return _round(S.winsor_zscore(rows, "value", "z", ["yr"], ddof=0).select("entity", "yr", "code", "z"))


@query(f"WITH {BASE}, q AS (SELECT quantile_cont(revenue, 0.25e0) AS a, quantile_cont(revenue, 0.75e0) AS b FROM p) SELECT entity, yr, {R('greatest(least(revenue, b + 0.2e0 * (b - a)), a - 0.2e0 * (b - a))', 3)} AS revenue FROM p, q")
def tukey_clip(spark, d):
    return _round(S.tukey_clip(base(spark, d).select("entity", "yr", "revenue"), ["revenue"], 0.2), 3)


@query(f"WITH {LONG} SELECT code, {R('quantile_cont(value, 0.05e0)', 4)} AS lo, {R('quantile_cont(value, 0.95e0)', 4)} AS hi FROM lg GROUP BY code")
def winsor_bounds(spark, d):
    return _round(S.winsor_bounds(long(spark, d), "value", ["code"]), 4)


@query(f"""WITH {BASE}, {_z('p', 'revenue')} SELECT entity, yr, {R('(coalesce(z, 0) * 0.5e0 + coalesce(gap, 0) * 0.25e0) / NULLIF(CASE WHEN z IS NOT NULL THEN 0.5e0 ELSE 0 END + CASE WHEN gap IS NOT NULL THEN 0.25e0 ELSE 0 END, 0)')} AS weighted, CAST(1 + CASE WHEN gap IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_used, CASE WHEN gap IS NOT NULL THEN 'High' ELSE 'Low' END AS tier FROM z_""")
def weighted_composite_tier(spark, d):
    z = S.winsor_zscore(base(spark, d), "revenue", "z")
    out = z.withColumns({"weighted": X.weighted_mean(["z", "gap"], [0.5, 0.25]), "n_used": X.row_count(["z", "gap"])})
    return _round(out.withColumn("tier", X.trust_tier("n_used", 2, 3)).select("entity", "yr", "weighted", "n_used", "tier"))


# Panel operators

@query(f"""WITH {BASE}, y AS (SELECT yr, median(gap) AS m FROM p GROUP BY yr), f AS (SELECT entity, p.yr, coalesce(gap, m) AS g FROM p JOIN y USING (yr)), g AS (SELECT median(g) AS m FROM f) SELECT entity, yr, {R('coalesce(f.g, g.m, 0)')} AS gap FROM f, g""")
def impute_year_then_global_median(spark, d):
    return _round(panel.impute(base(spark, d).select("entity", "yr", "gap"), ["gap"], "yr"))


_FILL = f"""WITH {BASE}, r AS (SELECT entity, yr, gap, row_number() OVER (PARTITION BY entity ORDER BY yr) AS i FROM p),
w AS (SELECT *, max(CASE WHEN gap IS NOT NULL THEN i END) OVER (PARTITION BY entity ORDER BY i) AS pi, min(CASE WHEN gap IS NOT NULL THEN i END) OVER (PARTITION BY entity ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM r),
v AS (SELECT w.entity, w.yr, w.i, w.gap, a.i AS pi, a.gap AS pv, b.i AS ni, b.gap AS nv FROM w LEFT JOIN r a ON a.entity = w.entity AND a.i = w.pi LEFT JOIN r b ON b.entity = w.entity AND b.i = w.ni)"""


@query(f"{_FILL} SELECT entity, yr, {R('coalesce(gap, pv + (nv - pv) * (i - pi) / NULLIF(ni - pi, 0), pv, nv)')} AS gap FROM v")
def interpolate_by_row(spark, d):
    return _round(panel.interpolate(base(spark, d).select("entity", "yr", "gap"), ["gap"], "entity", "yr"))


@query(f"{_FILL} SELECT entity, yr, {R('coalesce(pv, nv)')} AS gap FROM v")
def ffill_bfill(spark, d):
    return _round(panel.fill(base(spark, d).select("entity", "yr", "gap"), ["gap"], "entity", "yr"))


@query(f"""WITH {BASE}, s AS (SELECT yr AS y, sum(revenue) AS national FROM p WHERE yr % 3 = 0 GROUP BY yr), x AS (SELECT entity, yr, national, row_number() OVER (PARTITION BY entity, yr ORDER BY abs(yr - y), y) AS k FROM p, s) SELECT entity, yr, {R('national', 2)} AS national FROM x WHERE k = 1""")
def nearest_year_join(spark, d):
    p = base(spark, d)
    s = p.filter("yr % 3 = 0").groupBy("yr").agg(F.sum("revenue").alias("national"))
    return _round(panel.nearest(p.select("entity", "yr"), s, "yr", ["national"]), 2)


@query(f"""WITH {BASE}, f AS (SELECT entity, sum(coalesce(gap, 0)) AS g FROM p GROUP BY entity) SELECT entity, yr, {R('coalesce(gap, g)')} AS gap FROM p JOIN f USING (entity)""")
def state_fallback_join(spark, d):
    p = base(spark, d).select("entity", "yr", "gap")
    return _round(panel.with_fallback(p, panel.group_sum(p, ["entity"], ["gap"]), ["entity"], ["gap"]))


@query(f"""WITH {BASE} SELECT coalesce(a.entity, b.entity) AS entity, CAST(coalesce(a.yr, b.yr) AS INTEGER) AS yr, {R('avg(a.qty)')} AS qty, {R('avg(b.disc)')} AS disc FROM (SELECT * FROM p WHERE nk % 2 = 0) a FULL JOIN (SELECT * FROM p WHERE yr % 2 = 0) b ON a.entity = b.entity AND a.yr = b.yr GROUP BY 1, 2""")
def outer_join_remean(spark, d):
    p = base(spark, d)
    return _round(panel.outer_mean(p.filter("nk % 2 = 0").select("entity", "yr", "qty"), p.filter("yr % 2 = 0").select("entity", "yr", "disc"), ["entity", "yr"]))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL")
def left_join_metadata_filter(spark, d):
    c = _t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return _t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").filter("c_mktsegment IS NOT NULL").select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def semi_min_obs(spark, d):
    return panel.with_min_rows(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_unmatched(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(f"""WITH {LONG} SELECT entity, yr, {', '.join(R(f"avg(value) FILTER (code = '{c}')", 4 if c == 'revenue' else 6) + f' AS {c}' for c, _, _ in CODES)} FROM lg GROUP BY entity, yr""")
def panel_pivot(spark, d):
    return _round(panel.pivot_mean(long(spark, d), ["entity", "yr"], "code", "value", [c for c, _, _ in CODES]), revenue=4)


@query(f"WITH {BASE} SELECT entity, yr, 'gap' AS code, {R('gap')} AS value FROM p UNION ALL SELECT entity, yr, 'disc', {R('disc')} FROM p")
def panel_unpivot(spark, d):
    return _round(panel.unpivot(base(spark, d).select("entity", "yr", "gap", "disc"), ["entity", "yr"], ["gap", "disc"]))


@query(f"WITH {LONG} SELECT code, {R('count(value) / 1.0e0 / (SELECT count(*) FROM p)')} AS panel_coverage FROM lg GROUP BY code")
def panel_coverage(spark, d):
    return _round(panel.coverage(long(spark, d), ["entity", "yr"], "code", "value"))


@query(f"WITH {BASE} SELECT entity, yr, {R('qty - avg(qty) OVER (PARTITION BY entity) + 0')} AS qty FROM p")
def demean_entity(spark, d):
    return _round(panel.demean(base(spark, d).select("entity", "yr", "qty"), ["qty"], "entity", None))


@query(f"WITH {BASE} SELECT entity, yr, {R('qty - avg(qty) OVER (PARTITION BY entity) - avg(qty) OVER (PARTITION BY yr) + avg(qty) OVER ()')} AS qty FROM p")
def demean_two_way(spark, d):
    return _round(panel.demean(base(spark, d).select("entity", "yr", "qty"), ["qty"], "entity", "yr"))


@query(f"WITH {BASE} SELECT entity, yr, {R('lag(qty) OVER w')} AS qty_lag1, {R('lead(qty) OVER w')} AS qty_lead1 FROM p WINDOW w AS (PARTITION BY entity ORDER BY yr)")
def lag_lead(spark, d):
    p = base(spark, d).select("entity", "yr", "qty")
    return _round(panel.shifted(panel.shifted(p, ["qty"], "entity", "yr", 1), ["qty"], "entity", "yr", -1).drop("qty"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedup_keep_last(spark, d):
    return panel.keep_one(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedup_keep_first(spark, d):
    return panel.keep_one(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT s_nationkey, CAST(year(l_shipdate) AS INTEGER) AS yr, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def large_group_totals(spark, d):
    j = _t(spark, d, "lineitem").join(_t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = panel.group_sum(j.select("s_nationkey", F.year("l_shipdate").alias("yr"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")), ["s_nationkey", "yr"], ["quantity", "price"])
    return g.withColumns({c: F.round(c, 2) for c in ("quantity", "price")})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def profile_group_count(spark, d):
    return panel.profile_counts(_t(spark, d, "events").select("event_id", "event_type", "value"))


# Statistics

@query(f"""WITH {LONG} SELECT a.code AS a, b.code AS b, count(*) AS n, {R('covar_pop(a.value, b.value) / NULLIF(stddev_pop(a.value) * stddev_pop(b.value), 0)')} AS corr FROM lg a JOIN lg b ON a.entity = b.entity AND a.yr = b.yr AND a.code < b.code WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2""")
def corr_pairs(spark, d):
    return _round(S.corr_pairs(long(spark, d), "code", ["entity", "yr"], "value"))


_RANK = "rank() OVER (PARTITION BY yr ORDER BY {0}) + (count(*) OVER (PARTITION BY yr, {0}) - 1) / 2.0e0"


@query(f"""WITH {BASE}, f AS (SELECT yr, {_RANK.format('revenue')} AS x, {_RANK.format('gap')} AS y FROM p WHERE gap IS NOT NULL) SELECT yr, count(*) AS n, {R('covar_pop(x, y) / NULLIF(stddev_pop(x) * stddev_pop(y), 0)')} AS rho FROM f GROUP BY yr HAVING count(*) >= 5""")
def spearman_by_year(spark, d):
    return _round(S.spearman(base(spark, d), "revenue", "gap", ["yr"]))


@query(f"""WITH {BASE}, v AS (SELECT entity, yr, round(disc, 2) AS v FROM p), r AS (SELECT *, rank() OVER (PARTITION BY yr ORDER BY v DESC) + (count(*) OVER (PARTITION BY yr, v) - 1) / 2.0e0 AS r FROM v) SELECT entity, yr, r, r <= 5 AS top5 FROM r""")
def avg_rank_topk(spark, d):
    v = base(spark, d).select("entity", "yr", F.round("disc", 2).alias("v"))
    return average_ranks(v, "v", "r", ["yr"], big=big_groups(v, ["yr"])).select("entity", "yr", "r", (F.col("r") <= 5).alias("top5"))


def _vif_frame(spark, d):
    got = S.vif(base(spark, d).withColumn("n_orders", F.col("n_orders").cast("double")), ["n_orders", "revenue", "qty", "disc"])
    return spark.createDataFrame([(k, v) for k, v in got.items()], "code string, vif double")


@query()
def vif_report(spark, d):
    return _round(_vif_frame(spark, d))


@query(f"""WITH {BASE}, v AS (SELECT revenue - avg(revenue) OVER (PARTITION BY entity) - avg(revenue) OVER (PARTITION BY yr) + avg(revenue) OVER () AS y, CAST(n_orders AS DOUBLE) - avg(n_orders) OVER (PARTITION BY entity) - avg(n_orders) OVER (PARTITION BY yr) + avg(n_orders) OVER () AS x, entity FROM p),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM v), s AS (SELECT entity, sum(x * (y - b.b * x)) AS s FROM v, b GROUP BY entity), m AS (SELECT sum(s * s) AS m, count(*) AS g FROM s)
SELECT 'n_orders' AS term, round(b, 4) + 0.0e0 AS coef, round(sqrt(m) / xx * sqrt((g / (g - 1.0e0)) * ((n - 1.0e0) / (n - 1.0e0))), 4) + 0.0e0 AS se, CAST(n AS BIGINT) AS n FROM b, m""")
def ols_twfe_clustered(spark, d):
    p = base(spark, d).withColumn("n_orders", F.col("n_orders").cast("double"))
    f = econometrics.ols(p, "revenue", ["n_orders"], "entity", "yr")
    return spark.createDataFrame([("n_orders", round(f.coef[0], 4), round(f.se[0], 4), f.n)], "term string, coef double, se double, n long")


@query(f"""WITH {BASE}, u AS (SELECT entity, yr, qty - (SELECT avg(qty) FROM p) AS u FROM p), l AS (SELECT u, u - lag(u) OVER (ORDER BY entity, yr) AS d FROM u) SELECT {R('sum(d * d) / sum(u * u)')} AS dw FROM l""")
def durbin_watson(spark, d):
    p = base(spark, d)
    u = S._back(p, p.agg(F.avg("qty").alias("_m")), []).withColumn("u", F.col("qty") - F.col("_m"))
    return _round(econometrics.durbin_watson(u, "u", "entity", "yr"))


@query()
def placebo_permutation(spark, d):
    return econometrics.placebo(base(spark, d).select("entity", "yr", "qty", "gap"), ["qty", "gap"], "entity", "yr", 2026)


@query()
def rank_stability(spark, d):
    return econometrics.rank_stability(base(spark, d), ["qty", "gap", "ret"], "entity", "yr")


@query(f"""WITH {BASE}, f AS (SELECT yr, {_RANK.format('revenue')} AS x, {_RANK.format('qty')} AS y FROM p) SELECT yr, count(*) AS n, {R('covar_pop(x, y) / NULLIF(stddev_pop(x) * stddev_pop(y), 0)')} AS rho FROM f GROUP BY yr HAVING count(*) >= 5""")
def method_agreement(spark, d):
    p = base(spark, d)
    return _round(econometrics.method_agreement(p, p, ["entity", "yr"], "revenue", "qty", ["yr"]))


# Gating

def _stats(spark, d):
    rows = long(spark, d).filter("value IS NOT NULL").select(F.col("code").alias("indicator_code"), F.col("code").alias("indicator_name"), F.lit(None).cast("string").alias("pillar"), F.col("entity").alias("economy"), F.col("yr").alias("year"), "value", (F.col("nk") % 5 == 0).alias("was_imputed"))
    observed = rows.select("indicator_code").distinct().withColumn("pct_observed", F.when(F.col("indicator_code") == "gap", 60.0).otherwise(90.0))
    return rows, gating.indicator_stats(rows, observed)


_GATE = f"""WITH {LONG}, v AS (SELECT * FROM lg WHERE value IS NOT NULL), s AS (SELECT code AS indicator_code, count(DISTINCT yr) AS years_covered, count(DISTINCT entity) AS economies_covered, avg(CASE WHEN nk % 5 = 0 THEN 1.0e0 ELSE 0 END) AS imputation_share, CASE WHEN code = 'gap' THEN 60.0e0 ELSE 90.0e0 END AS pct, count(DISTINCT (entity, yr)) / 1.0e0 / (SELECT count(DISTINCT (entity, yr)) FROM v) AS cov FROM v GROUP BY code),
g AS (SELECT *, pct + 100 * cov + 0.25e0 * years_covered + 0.1e0 * economies_covered - 50 * imputation_share AS ranking_score, pct >= 70 AND imputation_share <= 0.35 AND years_covered >= 5 AND cov >= 0.4 AS gate_pass, CASE WHEN indicator_code = 'revenue' THEN 'ECO' ELSE 'OUT' END AS domain FROM s)"""


@query(f"{_GATE} SELECT indicator_code, years_covered, economies_covered, {R('imputation_share')} AS imputation_share, {R('ranking_score')} AS ranking_score, gate_pass FROM g")
def indicator_stats_gate(spark, d):
    return _round(gating.gated(_stats(spark, d)[1]).select("indicator_code", "years_covered", "economies_covered", "imputation_share", "ranking_score", "gate_pass"))


@query(f"""{_GATE}, h AS (SELECT indicator_code, gate_pass, ranking_score, CASE WHEN indicator_code < 'h' THEN 'A' ELSE 'B' END AS domain FROM g), n AS (SELECT domain, greatest(least(count(*) FILTER (gate_pass), 2), 2) AS k FROM h GROUP BY domain), r AS (SELECT h.*, k, row_number() OVER (PARTITION BY domain ORDER BY gate_pass DESC, ranking_score DESC, indicator_code) AS i FROM h JOIN n USING (domain)) SELECT domain, indicator_code, gate_pass FROM r WHERE i <= k""")
def topk_backfill_per_domain(spark, d):
    g = gating.gated(_stats(spark, d)[1]).withColumn("domain", F.when(F.col("indicator_code") < "h", "A").otherwise("B"))
    return gating.picked(g, min_per_domain=2, max_per_domain=2).select("domain", "indicator_code", "gate_pass")


@query()
def indicator_selection(spark, d):
    rows, stats = _stats(spark, d)
    chosen, intake = gating.selected(rows, stats, min_per_domain=2)
    return intake.select("indicator_code", "domain", "gate_pass", "role")


@query("""SELECT p_partkey, CASE WHEN t LIKE '%skill%' OR t LIKE '%training%' THEN 'SKL' WHEN t LIKE '%connect%' OR t LIKE '%mobile%' THEN 'ACC' WHEN t LIKE '%service%' THEN 'SRV' WHEN t LIKE '%trust%' THEN 'AGR' WHEN t LIKE '%trade%' THEN 'ECO' WHEN p_size % 2 = 0 THEN 'ACC' ELSE 'OUT' END AS domain FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN 'mobile training' WHEN p_size % 7 = 1 THEN 'trade connect' WHEN p_size % 7 = 2 THEN 'service trust' WHEN p_size % 7 = 3 THEN 'trade' ELSE 'x' END AS t FROM part)""")
def classify_text_domain(spark, d):
    p = _t(spark, d, "part")
    name = F.when(F.col("p_size") % 7 == 0, "Mobile training").when(F.col("p_size") % 7 == 1, "Trade connect").when(F.col("p_size") % 7 == 2, "Service trust").when(F.col("p_size") % 7 == 3, "Trade").otherwise("x")
    return p.select("p_partkey", X.classify_domain(name, F.lit("c"), F.when(F.col("p_size") % 2 == 0, "access_usage")).alias("domain"))


# Verification

@query(f"""WITH {BASE} SELECT 'gap' AS "column", count(*) AS n_rows, count(*) - count(gap) AS n_null, {R('(count(*) - count(gap)) / 1.0e0 / count(*)')} AS null_rate, CASE WHEN count(*) = count(gap) THEN 'ok' WHEN (count(*) - count(gap)) / 1.0e0 / count(*) < 0.2 THEN 'warning' ELSE 'error' END AS severity FROM p UNION ALL SELECT 'qty', count(*), 0, 0.0e0, 'ok' FROM p""")
def verify_nulls(spark, d):
    return _round(verify.null_report(base(spark, d), ["gap", "qty"]))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def verify_duplicates(spark, d):
    return verify.duplicate_report(_t(spark, d, "events"), ["user_id", "event_type"])


@query("""SELECT 'l_discount' AS "column", count(*) FILTER (l_discount < 0.01) AS n_low, count(*) FILTER (l_discount > 0.08) AS n_high FROM lineitem UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity < 2), 0 FROM lineitem""")
def verify_ranges(spark, d):
    return verify.range_report(_t(spark, d, "lineitem"), {"l_discount": (0.01, 0.08), "l_quantity": (2.0, None)})


@query("""WITH l AS (SELECT 'price' AS "column", l_extendedprice AS v FROM lineitem UNION ALL SELECT 'qty', l_quantity FROM lineitem), q AS (SELECT "column", count(*) AS n, quantile_cont(v, 0.25e0) AS a, quantile_cont(v, 0.75e0) AS b FROM l GROUP BY 1), f AS (SELECT "column", n, a - 0.5e0 * (b - a) AS lo, b + 0.5e0 * (b - a) AS hi FROM q WHERE n >= 10 AND b > a) SELECT l."column", n, round(lo, 2) AS lo, round(hi, 2) AS hi, count(*) FILTER (v < lo OR v > hi) AS n_out FROM l JOIN f USING ("column") GROUP BY ALL""")
def verify_outliers(spark, d):
    return _round(verify.outlier_report(_wide(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty")), ["price", "qty"], 0.5), 2)


@query("SELECT min(y) AS lo, max(y) AS hi, count(DISTINCT y) AS n_times, count(*) FILTER (y < 1996 OR y > 2000) AS n_out FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)")
def verify_year_coverage(spark, d):
    return verify.coverage_report(_t(spark, d, "orders").select(F.year("o_orderdate").alias("y")), "y", 1996, 2000)


@query("SELECT count(DISTINCT u) AS n_entities, count(DISTINCT t) AS n_times, count(DISTINCT (u, t)) AS n_cells, round(count(DISTINCT (u, t)) / 1.0e0 / (count(DISTINCT u) * count(DISTINCT t)), 6) AS balance FROM (SELECT user_id AS u, CAST(ts AS DATE) AS t FROM events)")
def verify_balance(spark, d):
    return _round(verify.balance_report(_t(spark, d, "events").select(F.col("user_id").alias("u"), F.to_date("ts").alias("t")), "u", "t"))


@query("""SELECT 'x' AS "column", count(*) FILTER (p_size % 3 = 0) AS n_lost FROM part""")
def fuzzy_numeric_coercion(spark, d):
    x = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("d"))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5")))
    return verify.coercion_report(_t(spark, d, "part").select(x.alias("x")), ["x"])


@query(f"WITH {BASE} SELECT count(*) AS n_rows, count(*) - count(gap) AS n_missing, (count(*) - count(gap)) / 1.0e0 / count(*) <= 0.25 AS ok FROM p")
def verify_completeness(spark, d):
    return verify.completeness_report(base(spark, d), "gap")


@query(f"WITH {BASE} SELECT count(*) AS n_rows, count(*) FILTER (gap IS NULL) AS n_short FROM p")
def verify_domains(spark, d):
    return verify.domains_report(base(spark, d), ["gap", "qty"], 2)


@query("SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, count(*) AS n FROM events WHERE trim(props) <> '' GROUP BY 1")
def verify_key_sets(spark, d):
    return verify.key_sets(_t(spark, d, "events"), "props")


@query(f"""WITH {BASE} SELECT 'gap' AS "column", count(*) AS n_rows, count(gap) AS n_observed, {R('1 - count(gap) / 1.0e0 / count(*)')} AS missing_rate FROM p UNION ALL SELECT 'ret', count(*), count(ret), {R('1 - count(ret) / 1.0e0 / count(*)')} FROM p""")
def missingness_report(spark, d):
    return _round(verify.missingness(base(spark, d), ["gap", "ret"]))


# Text. Keywords are a configuration's.
KEYWORDS = text.keyword_index({"ACC": {"en": ["the", "that "], "fr": ["le "]}, "ECO": {"en": ["ing "], "de": ["und", "der"]}, "OUT": {"es": ["ción"], "fr": ["tion"]}})
_NEWS = "n AS (SELECT *, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT *, " + ", ".join(" + ".join(f"CAST(contains(t, '{k}') AS INTEGER)" for x, _, k in KEYWORDS if x == dom) + f' AS "{dom}"' for dom in ("ACC", "ECO", "OUT")) + " FROM n), m AS (SELECT *, CASE WHEN \"ACC\" + \"ECO\" + \"OUT\" = 0 THEN 'UNMAPPED' WHEN \"ACC\" >= \"ECO\" AND \"ACC\" >= \"OUT\" THEN 'ACC' WHEN \"ECO\" >= \"OUT\" THEN 'ECO' ELSE 'OUT' END AS primary_domain FROM s)"


def _news(spark, d):
    docs = _wide(spark, d, "documents").select("doc_id", "text", "lang", "source").withColumn("title", F.lit(""))
    return text.map_articles(docs, KEYWORDS, summary="text")


@query(f'WITH {_NEWS} SELECT doc_id, "ACC" AS "score_ACC", "ECO" AS "score_ECO", "OUT" AS "score_OUT", primary_domain FROM m')
def keyword_domain_map(spark, d):
    return _news(spark, d).select("doc_id", "score_ACC", "score_ECO", "score_OUT", "primary_domain")


@query(f"WITH {_NEWS} SELECT lang, source, count(*) AS n, count(*) FILTER (primary_domain <> 'UNMAPPED') AS mapped, round(count(*) FILTER (primary_domain <> 'UNMAPPED') / 1.0e0 / count(*), 4) AS mapping_rate FROM m GROUP BY lang, source")
def news_summaries(spark, d):
    return text.news_summary(_news(spark, d), ["lang", "source"])


@query("""WITH a AS (SELECT event_id % 4000 AS k, ts, event_id, 0 AS b FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id % 4000, ts, event_id, 1 FROM events WHERE event_id % 2 = 1), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b DESC, ts DESC, event_id DESC) AS i FROM a) SELECT k, ts FROM l WHERE i = 1 AND ts >= TIMESTAMP '2024-01-25' - INTERVAL 14 DAYS""")
def rolling_intake_keep_last(spark, d):
    e = _t(spark, d, "events").select((F.col("event_id") % 4000).alias("k"), "ts", "event_id")
    kept = text.rolling_intake(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), key="k", published="ts", now="2024-01-25")
    return kept.select("k", "ts")


_TOK = "tk AS (SELECT doc_id, unnest(regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', ' ', 'g')), '\\s+')) AS t FROM documents), tokens AS (SELECT doc_id, t FROM tk WHERE length(t) > 1 AND t NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "))"


@query(f"WITH {_TOK}, i AS (SELECT t AS term, count(DISTINCT doc_id) AS df FROM tokens GROUP BY t) SELECT term, df, {R('ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE))')} AS idf FROM i")
def idf_table(spark, d):
    docs = _wide(spark, d, "documents")
    index = text.postings(docs, "doc_id", "text")
    return _round(text.idf(index, "doc_id", docs.agg(F.count("*").alias("n"))))


@query(f"""WITH {_TOK}, q AS (SELECT * FROM (VALUES ('idiot', 1), ('thion', 2), ('que', 1)) v(t, times)), tf AS (SELECT doc_id, t, count(*) AS tf FROM tokens WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t)
SELECT doc_id, round(sum(times * (1 + ln(CAST(tf AS DOUBLE))) * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE))), 3) AS score FROM tf JOIN df USING (t) JOIN q USING (t) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def tfidf_search(spark, d):
    return text.search(_wide(spark, d, "documents"), "idiot thion que thion", id_col="doc_id", text_col="text")


@query(f"""WITH {_TOK}, q AS (SELECT * FROM (VALUES ('a', 'idiot', 1), ('a', 'thion', 2), ('a', 'que', 1), ('b', 'erthing', 1), ('b', 'the', 1), ('b', 'ing', 1)) v(q, t, times)), tf AS (SELECT doc_id, t, count(*) AS tf FROM tokens WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT q, doc_id, round(sum(times * (1 + ln(CAST(tf AS DOUBLE))) * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE))), 3) AS score FROM tf JOIN df USING (t) JOIN q USING (t) GROUP BY q, doc_id) SELECT q, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS i FROM s) WHERE i <= 20""")
def tfidf_index(spark, d):
    """Two searches of one stored index."""
    path = scratch(spark)
    search_index.build(_wide(spark, d, "documents"), path, id_col="doc_id", text_col="text")
    a, b = (search_index.search(spark, path, q).select(F.lit(n).alias("q"), F.col("id").alias("doc_id"), "score") for n, q in (("a", "idiot thion que thion"), ("b", "erthing the ing")))
    return a.unionByName(b)


@query(f"""WITH {_TOK}, u AS (SELECT DISTINCT doc_id, t FROM tokens), n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id), x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL), j AS (SELECT a, b, CAST(c AS DOUBLE) / (m.n + k.n - c) AS jaccard FROM x JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b),
s AS (SELECT doc_id, list(t ORDER BY t) AS s FROM u GROUP BY doc_id), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM s) SELECT a, b, {R('jaccard')} AS jaccard FROM j JOIN r p ON p.doc_id = a JOIN r q ON q.doc_id = b WHERE jaccard >= 0.85 AND p.rep = a AND (q.rep = b OR q.rep = a)""")
def jaccard_near_dupes(spark, d):
    docs = _wide(spark, d, "documents").select("doc_id", X.tokens("text").alias("k"))
    return _round(text.jaccard_pairs(docs, "doc_id", "k"))


# Titles are the third to fifth words of a document, without what precedes the third one's second letter: they begin inside words.
@query("""WITH t AS (SELECT doc_id, text, substr(array_to_string(regexp_split_to_array(trim(text), '\\s+')[3:5], ' '), 2) AS title FROM documents) SELECT a.doc_id AS src, b.doc_id AS dst FROM t a JOIN t b ON a.title IS DISTINCT FROM b.title AND b.title <> '' AND contains(lower(a.text), lower(b.title))""")
def title_mention_backlinks(spark, d):
    docs = _wide(spark, d, "documents").select("doc_id", "text", F.substring(F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 3, 3), " "), 2, 1 << 30).alias("title"))
    return text.backlinks(docs, "doc_id", "title", "text")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def html_strip(spark, d):
    return _t(spark, d, "pages").select("page_id", X.strip_tags("html").alias("body"))


# Survey

_TYPES = ("click", "purchase", "view")


@query("""SELECT user_id, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'click'), 6) AS click, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase'), 6) AS purchase, round(arg_max(value, (ts, event_id)) FILTER (event_type = 'view'), 6) AS "view" FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id""")
def eav_collapse(spark, d):
    return _round(survey.collapse(_t(spark, d, "events"), key="user_id", question="event_type", value="value", order=["ts", "event_id"], questions=_TYPES))


_RESP = """r AS (SELECT o_orderkey AS response_id, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'p' || o_custkey END AS phone, CASE WHEN o_orderkey % 11 = 0 THEN 'no' ELSE 'Yes' END AS consent, CASE WHEN o_orderkey % 7 = 0 THEN 'true' ELSE '0' END AS breakoff_flag, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'x' END AS country, CAST(o_orderkey % 2000 AS VARCHAR) AS dur FROM orders)"""


def _responses(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("response_id"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("p"), F.col("o_custkey"))).alias("phone"), F.when(k % 11 == 0, "no").otherwise("Yes").alias("consent"), F.when(k % 7 == 0, "true").otherwise("0").alias("breakoff_flag"), F.when(k % 13 == 0, " ").otherwise("x").alias("country"), (k % 2000).cast("string").alias("interview_duration_sec"))


_ELIG = f"""{_RESP}, e AS (SELECT *, CASE WHEN phone <> '' THEN row_number() OVER (PARTITION BY phone ORDER BY response_id) ELSE 1 END AS nth FROM r), c AS (SELECT response_id, CASE WHEN consent = 'no' THEN 'consent_not_granted' WHEN nth > 1 THEN 'duplicate_response' WHEN breakoff_flag = 'true' THEN 'breakoff_detected' WHEN trim(country) = '' THEN 'missing_required_fields' WHEN CAST(dur AS INTEGER) <> 0 AND (CAST(dur AS INTEGER) < 120 OR CAST(dur AS INTEGER) > 1800) THEN 'duration_outlier' ELSE 'eligible_full_completion' END AS reason FROM e)"""


@query(f"WITH {_ELIG} SELECT response_id, reason, CASE WHEN reason IN ('breakoff_detected', 'missing_required_fields') THEN 'partial' WHEN reason = 'eligible_full_completion' THEN 'complete' ELSE 'invalid' END AS completion_status, reason = 'eligible_full_completion' AS eligible FROM c")
def eligibility_rules(spark, d):
    return survey.with_eligibility(_responses(spark, d), order="response_id", required=("consent", "country")).select("response_id", "reason", "completion_status", "eligible")


@query(f"WITH {_ELIG} SELECT response_id, reason FROM c")
def eligibility_stream(spark, d):
    """The responses as files that arrive in no order, judged by the stream."""
    folder = scratch(spark)
    r = _responses(spark, d)
    r.repartition(F.xxhash64("response_id")).write.json(f"{folder}/in")
    q = live.live_eligibility(spark, f"{folder}/in", r.schema.simpleString()[len("struct<") : -1].replace(":", " "), f"{folder}/out", f"{folder}/state", order="response_id", required=("consent", "country"))
    q.awaitTermination()
    return stateful.latest(spark, f"{folder}/out")


@query(f"WITH {_ELIG} SELECT reason AS value, count(*) AS n FROM c GROUP BY reason")
def eligibility_counts(spark, d):
    return survey.status_counts(survey.with_eligibility(_responses(spark, d), order="response_id", required=("consent", "country")), "reason")


@query(f"WITH {_ELIG} SELECT response_id, 200.0e0 AS amount, 'pending_review' AS payout_status FROM c WHERE reason = 'eligible_full_completion'")
def payout_review(spark, d):
    return survey.payouts(survey.with_eligibility(_responses(spark, d), order="response_id", required=("consent", "country")), 200.0).select("response_id", "amount", "payout_status")


@query("SELECT c_custkey AS response_id, f AS field, v AS value FROM (SELECT c_custkey, 'c_acctbal' AS f, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'half', CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 2 END FROM customer)")
def survey_long_export(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("response_id"), "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 2).alias("half"))
    return survey.long_export(c, fields=("c_acctbal", "half"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, d):
    return survey.status_counts(_t(spark, d, "events"), "event_type")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) WHERE g IS NULL OR g >= 3600000000""")
def resend_suppression(spark, d):
    return survey.without_resends(_t(spark, d, "events").select("user_id", "event_id", "ts"), key="user_id", time="ts", seconds=3600).select("user_id", "event_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600000000 THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL""")
def session_activity(spark, d):
    return survey.sessions(_t(spark, d, "events"), key="user_id", time="ts", gap_seconds=21600)


# Views

@query(f"""WITH {BASE}, y AS (SELECT yr, avg(revenue) AS m FROM p GROUP BY yr), l AS (SELECT yr, m, m - lag(m) OVER (ORDER BY yr) AS delta FROM y) SELECT l.yr, {R('m', 3)} AS mean_revenue, {R('delta', 3)} AS delta, arg_max(entity, revenue) AS best, arg_min(entity, revenue) AS worst, count(DISTINCT entity) AS n_entities FROM p JOIN l USING (yr) GROUP BY ALL""")
def kpi_block(spark, d):
    from pyspark.sql import Window

    y = base(spark, d).groupBy("yr").agg(F.avg("revenue").alias("mean_revenue"), F.max_by("entity", "revenue").alias("best"), F.min_by("entity", "revenue").alias("worst"), F.count_distinct("entity").alias("n_entities"))
    return _round(y.withColumn("delta", F.col("mean_revenue") - F.lag("mean_revenue").over(Window.orderBy("yr"))), 3)  # a row a year


@query("""SELECT CAST(date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS INTEGER) AS relative_day, round(avg(value) FILTER (user_id % 2 = 1), 6) AS control, round(avg(value) FILTER (user_id % 2 = 0), 6) AS treated FROM events WHERE date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) BETWEEN -10 AND 10 GROUP BY 1""")
def event_study_rows(spark, d):
    e = _t(spark, d, "events").withColumn("t", F.col("user_id") % 2 == 0)
    return _round(econometrics.event_study(e, "t", "ts", "value", "2024-01-15", 10))


@query("""WITH m AS (SELECT date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS d, event_type, user_id % 2 = 0 AS t, avg(value) AS v FROM events GROUP BY ALL) SELECT CAST(d AS INTEGER) AS relative_day, round(avg(v) FILTER (NOT t), 6) AS control, round(avg(v) FILTER (t), 6) AS treated FROM m WHERE d BETWEEN -10 AND 10 GROUP BY 1""")
def event_study_mean_of_means(spark, d):
    e = _t(spark, d, "events").withColumn("t", F.col("user_id") % 2 == 0)
    return _round(econometrics.event_study(e, "t", "ts", "value", "2024-01-15", 10, ["event_type"]))


_PLACES = [(f"c{i}", (i % 4) / 2 - 0.75, (i // 4) / 2 - 0.5) for i in range(12)]


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}e0, {y}e0)" for n, x, y in _PLACES)}) v(place, px, py)), e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), k AS (SELECT vec_id, place, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt((px - x) * (px - x) + (py - y) * (py - y)), place) AS i FROM e, c) SELECT vec_id, place, round(d, 6) AS distance FROM k WHERE i = 1""")
def spatial_nearest(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    c = spark.createDataFrame(_PLACES, "place string, px double, py double")
    return _round(spatial.nearest_place(e, c, x="x", y="y", place="place", px="px", py="py").select("vec_id", "place", "distance"))


@query("SELECT event_type, max(ts) AS latest, count(*) AS n FROM events GROUP BY event_type")
def latest_by_key(spark, d):
    return changes.latest_by(_t(spark, d, "events"), "event_type", "ts")


@query("""WITH a AS (SELECT event_type, max(ts) AS l, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), b AS (SELECT event_type, max(ts) AS l, count(*) AS n FROM events GROUP BY 1) SELECT event_type, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'gone' WHEN b.l > a.l THEN 'later' ELSE 'more' END AS change FROM a FULL JOIN b USING (event_type) WHERE a.n IS NULL OR b.n IS NULL OR b.l > a.l OR b.n > a.n""")
def change_detection(spark, d):
    e = _t(spark, d, "events")
    return changes.changed(changes.latest_by(e.filter("ts < '2024-01-20'"), "event_type", "ts"), changes.latest_by(e, "event_type", "ts"), "event_type")


@query("SELECT count(*) AS n_rows FROM lineitem")
def fingerprint_counts(spark, d):
    return changes.fingerprint(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"]).select("n_rows")


@query()
def fingerprint_digests(spark, d):
    return changes.fingerprint(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])


from panelweft.plans import further  # noqa: E402, F401  registers its queries
