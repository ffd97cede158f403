"""Rows of vectors: which take part, and how they are laid out in tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    infinite = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def matrix(column: pd.Series, kind=np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, kind) for v in column])


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Every row in one of n blocks of about equal size."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
