"""Status of a point from its neighbour counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE, UNSAFE, OUTLIER = "Safe", "Unsafe", "Outlier"


def classify(succ: Column | str, prev: Column | str, k: int | Column) -> Column:
    """Safe if later neighbours alone reach ``k``, Unsafe if all together do, else Outlier."""
    succ = F.col(succ) if isinstance(succ, str) else succ
    prev = F.col(prev) if isinstance(prev, str) else prev
    return F.when(succ >= k, SAFE).when(succ + prev >= k, UNSAFE).otherwise(OUTLIER)


def total_neighbors(succ: Column | str, prev: Column | str) -> Column:
    """All neighbours of a point; ``prev`` is a count, or a map from slide to count."""
    succ = F.col(succ) if isinstance(succ, str) else succ
    prev = F.col(prev) if isinstance(prev, str) else prev
    return succ + prev


def total_of_map(prev: Column | str) -> Column:
    """Sum over a map of counts per earlier slide."""
    return F.aggregate(F.map_values(prev), F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def expiry(seq: Column | str, width: int) -> Column:
    """Position at which a point leaves a window of ``width`` points."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return seq + F.lit(width)
