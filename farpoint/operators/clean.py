"""Sensor table preparation: plausibility, time buckets and first differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions.timeparts import bucket_time, parts_until
from farpoint.operators.numbering import number_rows

# Strict bounds (low, high) of plausible readings; None means open.
SENSOR_BOUNDS = {"Celsius": (30, 45), "EDA": (0, 500), "Z_axis": (-10, None)}
# Averaged columns and their names in the result.
SENSOR_MEANS = {
    "Z_axis": "Z_axis",
    "Y_axis": "Y_axis",
    "X_axis": "X_axis",
    "Celsius": "Celsius",
    "EDA": "EDA",
    "Battery": "avg(Battery)",
    "Event": "avg(Event)",
}
HOURLY_MEANS = {c: f"avg({c})" for c in ("Celsius", "Z-axis", "Y-axis", "X-axis", "EDA")}


def rename_axes(df: DataFrame) -> DataFrame:
    """``Z-axis`` to ``Z_axis`` and so on."""
    return df.withColumnsRenamed({f"{a}-axis": f"{a}_axis" for a in "ZYX"})


def plausible(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]] = SENSOR_BOUNDS) -> DataFrame:
    """Rows strictly inside all bounds."""
    for name, (low, high) in bounds.items():
        if low is not None:
            df = df.where(F.col(name) > low)
        if high is not None:
            df = df.where(F.col(name) < high)
    return df


def bucket_means(
    df: DataFrame,
    quantity: int,
    unit: str,
    means: Mapping[str, str] = SENSOR_MEANS,
    key: Sequence[str] = (),
    ordered: bool = False,
) -> DataFrame:
    """Averages per time bucket; the finest part is the bucket number inside the next coarser part."""
    parts = parts_until(unit)
    averages = [F.avg(F.col(f"`{c}`")).alias(name) for c, name in means.items()]
    result = bucket_time(df, quantity, unit).groupBy(*key, *parts).agg(*averages)
    return result.orderBy(*key, *parts) if ordered else result


def hourly_means(
    df: DataFrame, means: Mapping[str, str] = HOURLY_MEANS, key: Sequence[str] = (), ordered: bool = False
) -> DataFrame:
    """Averages per hour."""
    return bucket_means(df, 1, "hour", means, key, ordered)


def first_difference(
    df: DataFrame,
    order: Sequence[str],
    signed: Sequence[str] = ("Z_axis", "Y_axis", "X_axis"),
    absolute: Sequence[str] = ("EDA",),
    key: Sequence[str] = (),
    block_rows: int = 65_536,
) -> DataFrame:
    """Change of each row against the row before it in order, per key; the first row is dropped.

    ``signed`` columns become differences, ``absolute`` ones their magnitude, all others stay.
    Rows are numbered and cut into blocks of fixed size, and the last row of a block is copied to
    the next one, so a key with most of the rows is as parallel as any other.
    """
    keys = list(key)
    numbered = number_rows(df, order, keys, seq="_seq", total="_total")
    block = F.floor((F.col("_seq") - 1) / block_rows)
    ends_block = (F.col("_seq") % block_rows == 0) & (F.col("_seq") < F.col("_total"))
    blocks = F.when(ends_block, F.array(block, block + 1)).otherwise(F.array(block))
    copied = numbered.withColumn("_block", F.explode(blocks))
    in_order = Window.partitionBy(*keys, "_block").orderBy("_seq")
    changed = {c: F.col(f"`{c}`") - F.lag(F.col(f"`{c}`")).over(in_order) for c in [*signed, *absolute]}
    changed |= {c: F.abs(changed[c]) for c in absolute}
    columns = [changed.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]
    own_block = F.col("_block") == block
    with_change = copied.select(*columns, "_seq", own_block.alias("_own"))
    return with_change.where(F.col("_own") & (F.col("_seq") > 1)).select(*[F.col(f"`{c}`") for c in df.columns])
