"""Count-based sliding windows over numbered points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.specs import WindowSpec


def slide_of(seq: Column | str, spec: WindowSpec) -> Column:
    """Slide (pane) number from 0 of a point."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor((seq - 1) / F.lit(spec.slide)).cast("bigint")


def full_slides(spec: WindowSpec, total: str = "stream_rows") -> Column:
    """Number of slides that have all their points."""
    return F.floor(F.col(total) / F.lit(spec.slide)).cast("bigint")


def with_slides(numbered: DataFrame, spec: WindowSpec) -> DataFrame:
    """Add ``slide_id`` to numbered points."""
    return numbered.withColumn("slide_id", slide_of("seq", spec))


def window_ids(spec: WindowSpec, slide: str = "slide_id", total: str = "stream_rows") -> Column:
    """Array of the full windows a slide belongs to; empty if there is none."""
    first = F.greatest(F.col(slide), F.lit(spec.panes - 1))
    last = F.least(F.col(slide) + (spec.panes - 1), full_slides(spec, total) - 1)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def sliding_windows(numbered: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row per point and full window it lies in."""
    slides = with_slides(numbered, spec)
    return slides.withColumn("window_id", F.explode(window_ids(spec)))


def from_seq(spec: WindowSpec, window: str = "window_id") -> Column:
    return (F.col(window) - (spec.panes - 1)) * spec.slide + 1


def to_seq(spec: WindowSpec, window: str = "window_id") -> Column:
    return (F.col(window) + 1) * spec.slide


def window_bounds(numbered: DataFrame, spec: WindowSpec, key: Sequence[str] = ()) -> DataFrame:
    """First and last position and number of points of each full window.

    Points are summed up per slide before windows are formed, so the window expansion works on one
    row per slide.
    """
    slides = with_slides(numbered, spec).groupBy(*key, "slide_id").agg(
        F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n"),
        F.max("stream_rows").alias("stream_rows"),
    )
    return (
        slides.withColumn("window_id", F.explode(window_ids(spec)))
        .groupBy(*key, "window_id")
        .agg(F.min("lo").alias("from_seq"), F.max("hi").alias("to_seq"), F.sum("n").alias("points"))
    )


def slide_sizes(numbered: DataFrame, spec: WindowSpec, key: Sequence[str] = ()) -> DataFrame:
    """Points per slide, the trailing partial one included."""
    return with_slides(numbered, spec).groupBy(*key, "slide_id").agg(F.count("*").alias("points"))
