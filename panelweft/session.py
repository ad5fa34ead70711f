"""What a session needs to run this package's Python code on its executors."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark's file server, once for each application.

    A session whose user chose no Arrow batch size also gets a smaller one.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, "1000")  # rows hold texts: ten thousand of them are too much for one buffer
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="panelweft-")) / "panelweft_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def by_value(module: str) -> None:
    """Send what a module defines by value: the driver's own Python workers don't see shipped packages."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share; on one machine, where it is unset, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelweft-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession) -> str:
    """A new folder under shared_root()."""
    return f"{shared_root(spark).rstrip('/')}/panelweft-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what is used twice is computed once, and lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
