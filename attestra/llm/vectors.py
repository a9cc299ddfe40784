"""Vector columns as Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(id_col: str, vector_col: str) -> Column:
    """True for a row with an id and a vector of one or more finite components; never null."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(id_col).isNotNull() & F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def as_doubles(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("vector"), *more)


def matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of one length as a matrix; with ``width`` shorter rows end in zeros."""
    if width is None:
        return np.array(column.tolist(), dtype=np.float64)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def bucket(col: Column, seed: int, n: Column) -> Column:
    return F.pmod(F.xxhash64(col, F.lit(seed)), n).cast("int")
