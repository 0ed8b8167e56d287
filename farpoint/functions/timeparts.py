"""Date and time parts of sensor rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Input column and output column of each bucket unit, coarse to fine.
UNITS = {"day": "day", "hour": "hour", "minute": "minute", "second": "seconds"}
PARTS = ["year", "month", "day", "hour", "minute", "second"]
DATE_PATTERN = r"(\d{4}-\d{2}-\d{2})"
TIME_PATTERN = r"(\d{2}:\d{2}:\d{2})"


def parts_until(unit: str) -> list[str]:
    """Time parts from the year down to ``unit``."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}, expected one of {sorted(UNITS)}")
    return PARTS[: PARTS.index(unit) + 1]


def bucket_time(df: DataFrame, quantity: int, unit: str) -> DataFrame:
    """Replace the part named by ``unit`` by its bucket number, truncated toward zero."""
    parts_until(unit)
    source = UNITS[unit]
    bucket = (F.col(source) / F.lit(quantity)).cast("int")
    if source == unit:
        return df.withColumn(unit, bucket)
    return df.withColumn(unit, bucket).drop(source)


def timestamp_parts(ts: str) -> list[Column]:
    """Parts of a timestamp in the layout of a cleaned sensor table."""
    t = F.col(ts)
    return [
        F.year(t).alias("year"),
        F.month(t).alias("month"),
        F.dayofmonth(t).alias("day"),
        F.hour(t).alias("hour"),
        F.minute(t).alias("minute"),
        F.expr(f"CAST(extract(SECOND FROM {ts}) AS DOUBLE)").alias("seconds"),
    ]


def clock_parts(cell: Column) -> list[Column]:
    """``HH:MM:SS[.s]`` as hour, minute and seconds."""
    bits = F.split(cell, ":")
    return [
        bits.getItem(0).cast("int").alias("hour"),
        bits.getItem(1).cast("int").alias("minute"),
        bits.getItem(2).cast("double").alias("seconds"),
    ]
