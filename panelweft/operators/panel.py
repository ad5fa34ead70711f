"""Operators over entity x time panels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweft.functions.order import quantiles
from panelweft.functions.stats import _back
from panelweft.session import checkpoints, ship, stored


def select_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in order; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def select_available(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Of old name: new name, the columns that df has."""
    return df.select(*[F.col(k).alias(v) for k, v in columns.items() if k in df.columns])


def group_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def group_sum(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums in which a group of nulls is 0."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])


def pivot_mean(long: DataFrame, keys: Sequence[str], code: str, value: str, codes: Sequence[str]) -> DataFrame:
    """A column for each of the given codes; naming them saves a job."""
    return long.groupBy(*keys).pivot(code, list(codes)).agg(F.avg(value))


def unpivot(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], code: str = "code", value: str = "value") -> DataFrame:
    """A row for each column, nulls too."""
    return wide.unpivot(list(keys), list(columns), code, value)


def coverage(long: DataFrame, keys: Sequence[str], code: str, value: str) -> DataFrame:
    """(code, panel_coverage): share of the panel's cells that a code has a value in."""
    cells = long.select(*keys).distinct().agg(F.count("*").alias("_cells"))
    seen = long.filter(F.col(value).isNotNull()).groupBy(code).agg(F.count_distinct(*keys).alias("_seen"))
    all_codes = long.select(code).distinct().join(seen, code, "left")
    return _back(all_codes, cells, []).select(code, F.try_divide(F.coalesce("_seen", F.lit(0)).cast("double"), F.col("_cells").cast("double")).alias("panel_coverage"))


def impute(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Group median, then the median of what that gave, then 0."""
    df = stored(df)
    middle = lambda rows, by=(): quantiles(rows, columns, [0.5], by, kept=True).withColumnsRenamed({f"q{j}_0": f"_{c}" for j, c in enumerate(columns)})
    one = _back(df, middle(df, [by]), [by]).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
    one = stored(one)
    return _back(one, middle(one), []).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def interpolate(df: DataFrame, columns: Sequence[str], entity: str, time: str, by_time: bool = False) -> DataFrame:
    """Linear between neighbours by row (or by time), flat at both ends."""
    w = Window.partitionBy(entity).orderBy(time)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("_at", F.col(time).cast("double") if by_time else F.row_number().over(w).cast("double"))
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("t"), F.col(c).cast("double").alias("v")))
        out = out.withColumns({"_p": F.last(known, ignorenulls=True).over(before), "_n": F.first(known, ignorenulls=True).over(after)})
        line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.try_divide(F.col("_at") - F.col("_p.t"), F.col("_n.t") - F.col("_p.t"))
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), line, F.col("_p.v"), F.col("_n.v"))).drop("_p", "_n")
    return out.drop("_at")


def fill(df: DataFrame, columns: Sequence[str], entity: str, time: str) -> DataFrame:
    """The last known value, else the next."""
    w = Window.partitionBy(entity).orderBy(time)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)) for c in columns})


def nearest(left: DataFrame, right: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """The columns of right's row nearest in time (the earlier of two); null for a null time.

    Only distinct times are matched, by two ordered scans over the union of both sides'
    times: nothing is compared with everything, whatever the sides' sizes.
    """
    points = right.filter(F.col(time).isNotNull()).groupBy(time).agg(F.min(F.struct(*columns)).alias("_v"))
    asked = left.select(time).filter(F.col(time).isNotNull()).distinct()
    both = asked.select(time, F.lit(None).cast(points.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_ask")).unionByName(points.select(time, "_v", F.lit(False).alias("_ask")))
    # Times are few beside rows; they are put in order in ranges, and what the neighbours of a range hold is carried over.
    span = both.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    cells = _back(both, span, []).withColumn("_cell", F.floor(F.try_divide((F.col(time).cast("double") - F.col("lo").cast("double")) * 256.0, F.greatest(F.col("hi").cast("double") - F.col("lo").cast("double"), F.lit(1.0))))).drop("lo", "hi")
    known = F.when(~F.col("_ask"), F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))
    edge = cells.groupBy("_cell").agg(F.max(known).alias("_last"), F.min(known).alias("_first"))
    order = Window.orderBy("_cell")  # at most 257 rows
    edge = edge.select("_cell", F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_lp"), F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_fn"))
    w = Window.partitionBy("_cell").orderBy(time)
    local = cells.withColumns({"_p": F.max(known).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_n": F.min(known).over(w.rangeBetween(0, Window.unboundedFollowing))})
    at = local.filter("_ask").join(F.broadcast(edge), "_cell").withColumns({"_p": F.coalesce("_p", "_lp"), "_n": F.coalesce("_n", "_fn")})
    t = F.col(time).cast("double")
    pick = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (t - F.col("_p.t").cast("double") <= F.col("_n.t").cast("double") - t), F.col("_p.v")).otherwise(F.col("_n.v"))
    found = at.select(time, pick.alias("_v"))
    return left.join(found, time, "left").select(left["*"], *[F.col(f"_v.{c}").alias(c) for c in columns])


def with_fallback(df: DataFrame, fallback: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null columns filled from the row of fallback with the same keys."""
    other = fallback.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(other, list(keys), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def outer_mean(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on keys, then the mean of every measure by key."""
    joined = a.join(b, list(keys), "full_outer")
    return group_mean(joined, keys, [c for c in joined.columns if c not in keys])


def shifted(df: DataFrame, columns: Sequence[str], entity: str, time: str, by: int) -> DataFrame:
    """Lags (by > 0) or leads (by < 0) by rows of the entity, as c_lag1 or c_lead1."""
    w = Window.partitionBy(entity).orderBy(time)
    return df.withColumns({f"{c}_{'lag' if by > 0 else 'lead'}{abs(by)}": F.lag(c, by).over(w) for c in columns})


def demean(df: DataFrame, columns: Sequence[str], entity: str | None, time: str | None) -> DataFrame:
    """Entity and time means taken off, the grand mean put back (exact for balanced panels).

    Means are aggregates joined back: a time with very many rows is summed in parts.
    """
    out = df
    whole = df.agg(*[F.avg(c).alias(f"_g_{c}") for c in columns])
    parts = []
    for key, tag in ((entity, "_e_"), (time, "_t_")):
        if key:
            out = _back(out, df.groupBy(key).agg(*[F.avg(c).alias(f"{tag}{c}") for c in columns]), [key])
            parts.append(tag)
    out = _back(out, whole, [])
    new = {c: F.col(c) - sum((F.col(f"{t}{c}") for t in parts), F.lit(0.0)) + (F.col(f"_g_{c}") * (len(parts) - 1)) for c in columns}
    return out.withColumns(new).drop(*[f"{t}{c}" for t in ("_e_", "_t_", "_g_") for c in columns])


#: Times whose system the driver solves; panels of more are demeaned by alternating projections.
MAX_TIMES = 2048


def demean_exact(df: DataFrame, columns: Sequence[str], entity: str, time: str) -> DataFrame:
    """Columns without entity and time effects, exact for unbalanced panels too, and for ones that fall apart.

    Entities are absorbed, and what is left of the time effects is a system of a row a time
    (a Schur complement), which tasks sum up from blocks of entities and which is solved once.
    """
    spark = df.sparkSession
    ship(spark)
    df = stored(df)
    times = [r[0] for r in df.select(time).distinct().limit(MAX_TIMES + 1).collect()]
    if len(times) > MAX_TIMES:
        return demean_iterated(df, columns, entity, time)
    if not times:
        return df
    k, n_col = len(times), len(columns)
    places = spark.createDataFrame([(t, i) for i, t in enumerate(times)], T.StructType([T.StructField("_t", df.schema[time].dataType), T.StructField("_i", T.IntegerType())]))
    value = lambda c: F.col(c).cast("double")
    cells = df.join(F.broadcast(places), F.col(time).eqNullSafe(F.col("_t"))).groupBy(F.col(entity).alias("_e"), "_i").agg(F.count("*").alias("_n"), F.array(*[F.sum(value(c)) for c in columns]).alias("_s"))
    blocks = cells.groupBy("_e").agg(F.collect_list(F.struct("_i", "_n", "_s")).alias("c")).select("c")  # a row an entity, of at most a cell a time

    def summed(batches):
        m, b = np.zeros((k, k)), np.zeros((k, n_col))
        for batch in batches:
            c = batch.column(0)
            flat, at = c.flatten(), np.asarray(c.offsets)
            i, n, s = np.asarray(flat.field(0)), np.asarray(flat.field(1)).astype(float), np.asarray(flat.field(2).flatten()).reshape(-1, n_col)
            for x, y in zip(at - at[0], at[1:] - at[0], strict=False):
                j, w, z = i[x:y], n[x:y], s[x:y]
                m[np.ix_(j, j)] -= np.outer(w, w) / w.sum()
                m[j, j] += w
                b[j] += z - np.outer(w, z.sum(axis=0) / w.sum())
        whole = np.hstack([m, b])
        row, col = np.nonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(whole[row, col])], ["i", "j", "x"])

    whole = np.zeros((k, k + n_col))
    for r in blocks.mapInArrow(summed, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toLocalIterator():
        whole[r["i"], r["j"]] = r["x"]
    effect = np.linalg.lstsq(whole[:, :k], whole[:, k:], rcond=None)[0]
    known = spark.createDataFrame([(t, *map(float, effect[i])) for i, t in enumerate(times)], T.StructType([T.StructField("_t", df.schema[time].dataType), *[T.StructField(f"_f{j}", T.DoubleType()) for j in range(n_col)]]))
    less = df.join(F.broadcast(known), F.col(time).eqNullSafe(F.col("_t"))).withColumns({c: value(c) - F.col(f"_f{j}") for j, c in enumerate(columns)}).drop("_t", *[f"_f{j}" for j in range(n_col)])
    means = less.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return _back(less, means, [entity]).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).select(*df.columns)


def demean_iterated(df: DataFrame, columns: Sequence[str], entity: str, time: str, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """Alternating projections: exact for unbalanced panels too, to a part of each column's size. Lineage is cut by checkpoints; raises if most rounds aren't enough."""
    checkpoints(df.sparkSession)
    out = df
    size = df.agg(*[F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in columns]).first()
    for i in range(most):
        for key in (entity, time):
            means = out.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
            out = _back(out, means, [key]).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
        if i % 3 == 2:
            out = out.checkpoint()
            means = out.groupBy(entity).agg(*[F.abs(F.avg(c)).alias(c) for c in columns]).agg(*[F.max(c).alias(c) for c in columns]).first()
            if max((x or 0.0) / (s or 1.0) for x, s in zip(means, size, strict=True)) <= tolerance:
                return out
    raise ValueError(f"no convergence in {most} rounds")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an order that must be total."""
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*([c.desc() for c in ordered] if last else ordered))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_min_rows(df: DataFrame, entity: str, least: int) -> DataFrame:
    """Rows of entities that have at least so many."""
    kept = df.groupBy(entity).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(entity)
    return df.join(kept, entity, "left_semi")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def profile_counts(df: DataFrame, max_dims: int = 2) -> DataFrame:
    """Rows by the first columns that aren't numeric (null is a group)."""
    numeric = df.agg(*[F.coalesce(F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()) == 0, F.lit(False)).alias(c) for c in df.columns]).first()
    dims = [c for c in df.columns if not numeric[c]][:max_dims]
    return df.groupBy(*dims).agg(F.count("*").alias("n")) if dims else df.agg(F.count("*").alias("n"))
