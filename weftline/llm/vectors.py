"""Shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors that aren't null, empty or zero and hold no null or non-finite component."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))
