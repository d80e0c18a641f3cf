"""Order-insensitive comparison of results, with floats to nine digits."""

import numbers

import numpy as np
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "None"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, numbers.Number):
            return str(float(f"{float(v):.9g}"))
        if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
            return str([plain(x) for x in v])
        return str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
