"""Point streams: header line of attribute names, then numeric cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farpoint.functions.distance import as_double


def points_schema(names: Sequence[str]) -> T.StructType:
    """Cells are read as text, so that a bad one can be told from a missing one."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_points(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Points of a CSV file with a header line, cells still as text."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    return (reader.schema(points_schema(names)) if names else reader).csv(path)


def stream_points(spark: SparkSession, path: str, names: Sequence[str], files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream over a growing folder."""
    reader = spark.readStream.option("header", True).option("maxFilesPerTrigger", files_per_trigger)
    return reader.schema(points_schema(names)).csv(path)


def to_points(raw: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Numeric points, and the rows with a cell that is no number."""
    parsed = {c: as_double(c) for c in columns}
    good = None
    for value in parsed.values():
        ok = value.isNotNull() & ~F.isnan(value)
        good = ok if good is None else good & ok
    good = F.coalesce(good, F.lit(True))
    points = raw.where(good).select(*[parsed[c].alias(c) if c in parsed else F.col(f"`{c}`") for c in raw.columns])
    return points, raw.where(~good)
