"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C


def components(links: DataFrame, path: str) -> DataFrame:
    """(id, label): for every id in links(a, b), the smallest id that it reaches.

    Each round takes the least label among neighbours and then the label of that label, so
    the rounds grow with the logarithm of the longest path.  Every round is written under
    path and read back, so no lineage piles up and no vertex list leaves the executors.
    """
    spark = links.sparkSession
    edges = C.stored(links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/edges")
    labels = C.stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), f"{path}/labels0")
    n = 0
    while True:
        n += 1
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("k"), F.col("label").alias("up"))
        step = low.join(up, low.new == up.k, "left").select("id", F.least("new", "up").alias("label"), (F.least("new", "up") < F.col("old")).alias("moved"))
        now = C.stored(step, f"{path}/labels{n}")
        moved = now.agg(F.max(F.col("moved").cast("int"))).first()[0]
        C.remove(spark, f"{path}/labels{n - 1}")
        labels = now.select("id", "label")
        if not moved:
            return labels
