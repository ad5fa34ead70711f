"""Order statistics of groups of any size: exact quantiles, running sums, row numbers and ranks.

Spark's exact percentile holds a group's distinct values in one task, and a window sorts a
group there.  Here no task holds more than `small` rows of a group:

* quantiles() narrows each wanted rank down to a range of values that few rows fall into.  A
  pass over the data counts the rows of the ranges that are left by cells of order-preserving
  indices: first by sign and logarithm, then by even steps between a range's ends.  A double has
  64 bits and a pass tells 16 of them apart, so a few passes do, whatever the values are.
* running(), numbered() and average_ranks() deal groups of more than `small` rows by ranges of
  (group, order) and carry each range's total over to the next ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweft.session import stored

#: Rows of a group that one task may hold.
SMALL = 1 << 17
#: Cells that a range of values is cut into.
CELLS = 1 << 16
#: Ranges that are sent to every task; more are joined by a shuffle.
MAX_BROADCAST = 100_000
#: Rows of a range that a big group is dealt by.
DEALT_ROWS = 1 << 20


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & x.eqNullSafe(y)
    return out


def _magnitude(x: Column) -> Column:
    """An index that grows with x: some 12,000 cells of one sign and a quarter of a unit of the logarithm."""
    size = F.floor(F.ln(F.abs(x)) * 4) + 4000
    of = F.when(x == 0, F.lit(0).cast("long")).when(F.abs(x) == float("inf"), F.lit(1 << 20).cast("long")).otherwise(size)
    return F.when(x < 0, -of).otherwise(of)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), *, small: int = SMALL, cells: int = CELLS, kept: bool = False) -> DataFrame:
    """by, and q<j>_<i>: the interpolated quantile probs[i] of columns[j], exact; null for a group without values.

    Null and NaN aren't values. Without by there is one row, whatever df has. kept: df is cheap to read again.
    """
    keys = [f"g{i}" for i in range(len(by))]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.array(*[value(c) for c in columns]).alias("v"))
    rows = rows if kept else stored(rows)
    long = rows.select(*keys, F.posexplode("v").alias("c", "x"))
    group = [*keys, "c"]
    sizes = stored(long.groupBy(*group).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    level = sizes.filter("n > 0").select(*group, F.col("n").alias("total"), F.lit(0).cast("long").alias("below"), "n", "lo", "hi")
    at = [(F.floor(p * (F.col("total") - 1)), F.ceil(p * (F.col("total") - 1))) for p in probs]
    wide = (F.col("n") > small) & (F.col("lo") < F.col("hi"))

    def within(ranges: DataFrame, extra: Sequence[str]) -> DataFrame:
        """The rows of long in ranges, with columns of these; lo and hi of a range are called low and high."""
        few = ranges.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        r = ranges.select(*[F.col(g).alias(f"r_{g}") for g in group], *extra, F.col("lo").alias("low"), F.col("hi").alias("high"))
        on = _same([F.col(g) for g in group], [F.col(f"r_{g}") for g in group]) & F.col("x").between(F.col("low"), F.col("high"))
        return long.join(F.broadcast(r) if few else r, on)

    passes = 0
    while not (big := level.filter(wide)).isEmpty():
        step = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * cells)
        cell = _magnitude(F.col("x")) if passes == 0 else F.least(step, F.lit(cells - 1).cast("long"))
        counted = within(big, ["total", "below"]).groupBy(*group, "total", "below", "low", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = Window.partitionBy(*group, "low").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        wanted = F.lit(False)
        for pair in at:
            for k in pair:
                wanted = wanted | ((k >= F.col("below")) & (k < F.col("below") + F.col("n")))
        level = stored(level.filter(~wide).unionByName(placed.filter(wanted).select(*level.columns)))
        passes += 1
    if passes:
        values = within(level, ["total", "below"]).groupBy(*group, "total", "below", "low", "x").agg(F.count("*").alias("m"))
        before = Window.partitionBy(*group, "low").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    else:
        values = long.filter("x IS NOT NULL").groupBy(*group, "x").agg(F.count("*").alias("m")).withColumns({"total": F.sum("m").over(Window.partitionBy(*group)), "below": F.lit(0)})
        before = Window.partitionBy(*group).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("below") + F.coalesce(F.sum("m").over(before), F.lit(0))
    held = values.withColumn("first", first)
    here = lambda k: F.max(F.when((k >= F.col("first")) & (k < F.col("first") + F.col("m")), F.col("x")))
    picks = held.groupBy(*group, "total").agg(*[here(k).alias(f"{e}{i}") for i, pair in enumerate(at) for e, k in zip("lu", pair, strict=True)])
    lerp = [F.when(F.col(f"l{i}") == F.col(f"u{i}"), F.col(f"l{i}")).otherwise(F.col(f"l{i}") + (F.col(f"u{i}") - F.col(f"l{i}")) * (p * (F.col("total") - 1) - at[i][0])).alias(f"p{i}") for i, p in enumerate(probs)]
    every = picks.select(*group, *lerp).unionByName(sizes.select(*group, *[F.lit(None).cast("double").alias(f"p{i}") for i in range(len(probs))]))
    out = every.groupBy(*keys).agg(*[F.max(F.when(F.col("c") == j, F.col(f"p{i}"))).alias(f"q{j}_{i}") for j in range(len(columns)) for i in range(len(probs))])
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *[f"q{j}_{i}" for j in range(len(columns)) for i in range(len(probs))])


def big_groups(df: DataFrame, by: Sequence[str], small: int = SMALL) -> tuple[DataFrame, int] | None:
    """The groups of more than `small` rows, with their number of rows as `rows`, and all of these together; None if there are none."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("rows")).filter(F.col("rows") > small)
    found = stored(sizes)
    n = found.agg(F.sum("rows")).first()[0]
    return (found.select(*by), n) if n else None


def _apart(df: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df's rows of the big groups, and the others."""
    if not big.columns:
        return df, df.filter(F.lit(False))
    named = big.select(*[F.col(c).alias(f"_big{i}") for i, c in enumerate(big.columns)])
    on = _same([F.col(c) for c in big.columns], [F.col(c) for c in named.columns])
    return df.join(named, on, "left_semi"), df.join(named, on, "left_anti")


def _carried(df: DataFrame, by: Sequence[str], order: Sequence[Column], add: str, out: str, n_rows: int) -> DataFrame:
    """Running sums of add in total order, of big groups: ranges of (by, order), each with what the ranges before it add up to."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(max(width, -(-n_rows // DEALT_ROWS)), *[F.col(b) for b in by], *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part", *by).agg(F.sum(add).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carry = totals.select(F.col("_part").alias("_p"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn(out, F.sum(add).over(own))
    on = (F.col("_part") == F.col("_p")) & _same([F.col(b) for b in by], [F.col(f"_k{i}") for i in range(len(by))])
    return local.join(carry, on).withColumn(out, F.col(out) + F.col("_carry")).drop("_part", "_p", "_carry", *[f"_k{i}" for i in range(len(by))])


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], add: str, out: str, *, big: tuple[DataFrame, int] | None = None) -> DataFrame:
    """df with out: the sum of add over a group's rows up to this one; order is total.

    big: what big_groups() found for by, or for some of its columns.
    """
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda rows: rows.withColumn(out, F.sum(add).over(window))
    if big is None:
        return whole(df)
    large, others = _apart(df, big[0])
    return whole(others).unionByName(_carried(large, by, order, add, out, big[1]))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str, *, big: tuple[DataFrame, int] | None = None) -> DataFrame:
    """df with out: the number, from 1, of a row in its group; order is total."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), by, order, "_one", out, big=big).drop("_one")


def average_ranks(df: DataFrame, column: str, out: str, by: Sequence[str], *, descending: bool = True, big: tuple[DataFrame, int] | None = None) -> DataFrame:
    """df with out: the rank of column in its group, ties at their mean, null for null.

    Big groups are ranked by their distinct values, counted before they are dealt.
    """
    order = F.col(column).desc() if descending else F.col(column).asc()
    ties = F.count("*").over(Window.partitionBy(*by, column))
    last = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    plain = lambda rows: rows.withColumn(out, F.when(F.col(column).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(last)) + (ties - 1) / 2))
    if big is None:
        return plain(df)
    large, others = _apart(df, big[0])
    counted = large.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_times"))
    upto = _carried(counted, by, [order], "_times", "_upto", big[1])
    names = [*by, column]
    known = upto.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(names)], (F.col("_upto") - (F.col("_times") - 1) / 2).alias(out))
    on = _same([F.col(c) for c in by], [F.col(f"_v{i}") for i in range(len(by))]) & (F.col(column) == F.col(f"_v{len(by)}"))
    return plain(others).unionByName(large.join(known, on, "left").select(*df.columns, out))
