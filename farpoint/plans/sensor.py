"""From sensor readings to detected outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from farpoint.functions.timeparts import parts_until
from farpoint.operators.clean import SENSOR_BOUNDS, SENSOR_MEANS, bucket_means, first_difference, plausible, rename_axes
from farpoint.operators.evidence import window_report
from farpoint.operators.numbering import number_rows
from farpoint.sources.sensor import read_cleaned_files, write_csv
from farpoint.specs import Attr, OutlierParams, WindowSpec

# Attributes of the sensor job.
SENSOR_ATTRS = [Attr(n) for n in ("Z_axis", "Y_axis", "X_axis", "Celsius", "EDA")]


def clean_all(spark: SparkSession, folder: str, target: str, quantity: int, unit: str) -> None:
    """Bucketed averages of all cleaned files of a folder, written per patient."""
    table = plausible(rename_axes(read_cleaned_files(spark, folder)))
    means = bucket_means(table, quantity, unit, key=["patient_id"])
    means.write.partitionBy("patient_id").option("header", True).csv(f"{target}/{quantity}{unit}")


def sensor_outliers(
    readings: DataFrame,
    quantity: int,
    unit: str,
    spec: WindowSpec,
    params: OutlierParams,
    key: Sequence[str] = ("patient_id",),
    attrs: Sequence[Attr] = SENSOR_ATTRS,
    bounds: Mapping[str, tuple[float | None, float | None]] = SENSOR_BOUNDS,
    means: Mapping[str, str] = SENSOR_MEANS,
    signed: Sequence[str] = ("Z_axis", "Y_axis", "X_axis"),
    absolute: Sequence[str] = ("EDA",),
) -> DataFrame:
    """Clean, average per time bucket, difference and report outliers per key and window."""
    parts = parts_until(unit)
    averaged = bucket_means(plausible(readings, bounds), quantity, unit, means, key)
    changes = first_difference(averaged, parts, signed, absolute, key)
    numbered = number_rows(changes, parts, key)
    return window_report(numbered, spec, list(attrs), params, key, parts)


def write_report(report: DataFrame, path: str) -> None:
    """Window report as CSV with a header."""
    write_csv(report, path)
