"""Functions for SQL users, as SQL functions: they become expressions of the plan, without Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The complementary error function: its series below 2, its continued fraction from there on.
_ERFC = """
CASE WHEN x < 2 THEN 1 - 2 / sqrt(pi()) * aggregate(sequence(1, 60), named_struct('s', x, 'u', x),
   (a, n) -> named_struct('s', a.s - a.u * x * x / n * if(n % 2 = 1, 1D, -1D) / (2 * n + 1), 'u', a.u * x * x / n), a -> a.s)
 ELSE exp(-x * x) / (x * sqrt(pi())) / aggregate(sequence(120, 1, -1), 1D, (a, k) -> 1 + k / (2 * x * x) / a) END
"""


def register(spark: SparkSession, **own) -> None:
    """Register normal_p_value(t), erfc_of(x) for x of 0 or more, TABLE word_chunks(text, size, overlap), and own functions (UDFs) by name."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION erfc_of(x DOUBLE) RETURNS DOUBLE RETURN {_ERFC}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normal_p_value(t DOUBLE) RETURNS DOUBLE RETURN CASE WHEN NOT isnan(t) THEN erfc_of(abs(t) / sqrt(2D)) END")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION word_chunks(body STRING, size INT, overlap INT) RETURNS TABLE(no INT, chunk STRING) RETURN
      SELECT p.no, p.chunk FROM (SELECT posexplode(flatten(transform(array(filter(split(body, '\\\\s+'), x -> x <> '')), w -> transform(
        filter(sequence(1, greatest(size(w), 1), size - overlap), i -> size(w) > 0 AND (i = 1 OR i + overlap <= size(w))), i -> array_join(slice(w, i, size), ' '))))) AS (no, chunk)) p""")
    for name, f in own.items():
        spark.udf.register(name, f)
