"""What the two vector operators share: which vectors count, and their double-precision cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(~bad & some, F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    """rows x dimensions in double precision; shorter vectors are padded with zeros."""
    rows = [np.asarray(v, np.float64) for v in vectors]
    wide = max(map(len, rows), default=0)
    if all(len(r) == wide for r in rows):
        return np.stack(rows) if rows else np.zeros((0, 0))
    return np.stack([np.pad(r, (0, wide - len(r))) for r in rows])


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, scaled first so that large and small components neither overflow nor vanish."""
    most = np.maximum(np.abs(x).max(axis=1, initial=0.0), 1e-300)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / norms(x)[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, the same to the last bit whatever rows are around them."""
    return np.clip((unit(a) * unit(b)).sum(axis=1), -1.0, 1.0)


def dimension(df: DataFrame, column: str) -> int:
    return df.agg(F.max(F.size(column)).alias("d")).first()["d"] or 0
