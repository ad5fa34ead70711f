"""Fingerprints of tables and what changed between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, xor, total): a digest that doesn't depend on row order, by partial aggregation."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string").alias("total"))


def small_fingerprint(df: DataFrame, columns: Sequence[str], max_rows: int = 100_000) -> str:
    """SHA-256 of the sorted rows of a small table; its size is checked."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(line.alias("l"))
    if rows.count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: use fingerprint()")
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("l")), "\n"), 256)).first()[0]


def latest_by(df: DataFrame, key: str, time: str) -> DataFrame:
    """(key, latest, n)."""
    return df.groupBy(key).agg(F.max(time).alias("latest"), F.count("*").alias("n"))


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): new, gone, later or more, between two latest_by tables."""
    j = old.withColumnsRenamed({"latest": "_l", "n": "_n"}).join(new, key, "full_outer")
    what = F.when(F.col("_n").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("latest") > F.col("_l"), "later").when(F.col("n") > F.col("_n"), "more")
    return j.select(key, what.alias("change")).filter("change IS NOT NULL")


def should_rebuild(before: dict | None, after: dict) -> tuple[bool, list[str]]:
    """Whether a build is due, and why: first sync, other content, or a metric that rose."""
    if not before:
        return True, ["first_sync"]
    why = ["content_changed"] if (before.get("xor"), before.get("total")) != (after.get("xor"), after.get("total")) else []
    why += [f"{k}_increased" for k, v in after.items() if isinstance(v, int) and k not in ("xor",) and v > (before.get(k) or 0)]
    return bool(why), why


def reasons(before: DataFrame, after: DataFrame, *, source: str = "source", present: str = "present", digest: str = "digest", metrics: Sequence[str] = ("row_count",), latest: str = "max_year") -> DataFrame:
    """(source, reason) between two snapshots, a row a source: a new file, other content, a metric that differs, a later year.

    A source that isn't present now has none; with no snapshot before, the present ones are first syncs.
    """
    old = before.select(source, *[F.col(c).alias(f"_{c}") for c in (present, digest, *metrics, latest)])
    both = after.filter(F.col(present)).join(old, source, "left")
    had = F.coalesce(F.col(f"_{present}"), F.lit(False))
    why = [F.when(~had, "new_source_file"), F.when(had & ~F.col(digest).eqNullSafe(F.col(f"_{digest}")), "fingerprint_changed")]
    why += [F.when(had & (F.col(m) != F.col(f"_{m}")), f"{m}_changed") for m in metrics]
    why.append(F.when(had & (F.col(latest) > F.col(f"_{latest}")), f"{latest}_increased"))
    return both.select(source, F.explode(F.array_compact(F.array(*why))).alias("reason"))


def later_years(before: DataFrame, after: DataFrame, code: str, year: str = "max_year") -> DataFrame:
    """Codes whose last year rose; new codes aren't counted."""
    return after.join(before.select(code, F.col(year).alias("_y")), code).filter(F.col(year) > F.col("_y")).select(code, F.col("_y").alias("before"), F.col(year).alias("after"))
