"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.tables import shared_dir

#: Rows that go to a Python worker at a time where a table is stored; whole texts are among them.
BATCH = 1000


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(key, BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that an operator writes on its way, in a folder of their own, which goes when the result is kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self.tables)}-{name}"
        out = _written(df, path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove stored tables that nothing reads any more."""
        for t, path in self.tables:
            if any(t is x for x in tables):
                remove(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Store the result and remove everything else."""
        out = _written(df, f"{self.path}-result")
        remove(self.spark, self.path)
        return out


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small vocabulary file, as a driver-local path or through Spark's readers."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def connected_components(edges: DataFrame, name: str = "cc", store: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(a, b) links -> (node, root): every linked node with the smallest node it reaches.

    Alternating large-star and small-star steps until the links are stars: each node has one smaller neighbour,
    which has none. Each round is stored, so a lost executor costs one round. Both steps are an aggregate with
    map-side minimums and an equi-join that AQE can split when one node has very many links.
    """
    e = store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name
    )
    while True:
        seen = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        seen = seen.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if seen.where("up > 1 or up > 0 and down > 0").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = store(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
