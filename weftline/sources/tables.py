"""Reading the named tables of a data folder, and making this package known to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

import weftline


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(weftline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-code-"), "weftline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    context.addPyFile(path)
    context._weftline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach: spark.checkpoint.dir.

    Where that is unset, a temporary folder of this machine does for a local master; on a cluster its executors would
    each write to a disk of their own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table may be broadcast.
SMALL_ROWS = 100_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether df has at most `rows` rows; reading stops one row beyond."""
    return df.limit(rows + 1).count() <= rows


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """df as a Parquet table in a fresh place of the shared folder: read many times, made once. `batch` is how many rows Python gets at a time meanwhile."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(key)
    if batch:
        spark.conf.set(key, batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(tables: list[DataFrame]) -> None:
    """Take away what `stored` made, once nothing reads it any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
