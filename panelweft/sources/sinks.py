"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def snapshot_and_latest(df: DataFrame, root: str, run_ts: str) -> None:
    """A snapshot of the run, and the latest state."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(f"{root}/raw")
    df.sparkSession.read.parquet(f"{root}/raw").filter(F.col("run_ts") == run_ts).drop("run_ts").write.mode("overwrite").parquet(f"{root}/latest")


def table(df: DataFrame, name: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").saveAsTable(name)


def replaced_rows(df: DataFrame, path: str, key: str) -> None:
    """Rows of df's values of key in place of those that a table at path has (delete and insert), a partition a value."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def key_values(pairs: dict) -> str:
    """Lines of key=value, as CI systems read them."""
    return "\n".join(f"{k}={str(v).lower() if isinstance(v, bool) else v}" for k, v in pairs.items())
