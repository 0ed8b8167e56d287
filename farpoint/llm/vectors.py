"""Rows with usable vectors, and vectors as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True if a vector is not NULL or empty, has only finite components, and is not zero."""
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(value(x)) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: value(x) != 0), F.lit(False))


def usable_rows(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``_id`` and ``_v`` of the rows with an id and a usable vector."""
    rows = df.select(F.col(f"`{id_column}`").cast("bigint").alias("_id"), F.col(f"`{vector}`").alias("_v"))
    return rows.where(F.col("_id").isNotNull() & usable(F.col("_v")))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of a matrix in double precision."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])
