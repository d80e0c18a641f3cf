"""Views by name, and folders for tables that a query writes on its way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.registry import frames
from weftline.sources.tables import shared_dir


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frames(spark, sf_dir, [name])[name]


def work_dir(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach."""
    return f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
