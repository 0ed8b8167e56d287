"""Distances as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from farpoint.specs import Attr, used_attrs


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def mixed_distance(
    attrs: list[Attr], left: str = "", right: str = "b_", squared: bool = False
) -> Column:
    """``sqrt(sum of squared numeric gaps + number of differing nominal values)``.

    Columns are ``<left><name>`` and ``<right><name>``.
    """
    terms = []
    for a in used_attrs(attrs):
        x, y = F.col(f"`{left}{a.name}`"), F.col(f"`{right}{a.name}`")
        if a.numeric:
            gap = x.cast("double") - y.cast("double")
            terms.append(gap * gap)
        else:
            terms.append(F.when(x == y, 0.0).otherwise(1.0))
    total = _sum(terms)
    return total if squared else F.sqrt(total)


def vector_distance(a: Column | str, b: Column | str, dims: int | None = None) -> Column:
    """Euclidean distance of two array columns.

    With ``dims`` the sum is written out element by element, which Spark compiles; without it the
    arrays may have any length and the sum is folded.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    if dims is not None:
        gaps = [a.getItem(i).cast("double") - b.getItem(i).cast("double") for i in range(dims)]
        return F.sqrt(_sum([g * g for g in gaps]))
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def lone(attrs: list[Attr], radius: float) -> Column:
    """True for points that nothing can be within ``radius`` of, not even a copy.

    A NULL, NaN or infinite number has no distance. A NULL nominal value differs from every value, NULL
    included, so points with too many of them are too far from all others.
    """
    odd, nulls = F.lit(False), F.lit(0)
    for a in used_attrs(attrs):
        value = F.col(f"`{a.name}`")
        if a.numeric:
            odd = odd | ~F.coalesce(F.abs(value.cast("double")) < F.lit(float("inf")), F.lit(False))
        else:
            nulls = nulls + value.isNull().cast("int")
    return odd | (nulls > F.lit(float(radius) * float(radius)))


def within(distance: Column, radius: float) -> Column:
    """1 if the distance is at most the radius, else 0."""
    return (distance <= F.lit(float(radius))).cast("int")


def rounded(distance: Column | str, digits: int = 6) -> Column:
    """``F.round`` of a distance, with the same results.

    Spark rounds doubles through decimal numbers, which costs more than the test of a pair. A whole number divided by a power of ten
    is the double nearest to that decimal, so only what lies near a tie, is large, negative or no number is left to it.
    """
    distance = F.col(distance) if isinstance(distance, str) else distance
    scaled = distance * F.lit(10.0**digits)
    plain = (distance >= 0) & (scaled < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(F.round(distance, digits))


def as_double(column: str) -> Column:
    """Numeric value of a cell; text that is no number becomes NULL."""
    return F.expr(f"try_cast(trim(`{column}`) AS DOUBLE)")
