"""Neighbour counts from sorted values, without forming pairs.

With a single numeric attribute the points within a radius are an interval of the sorted values, so
their number is the difference of two running counts. A difference in nominal attributes shortens
the interval, and which of them differ is settled by counting with some of them required equal and
adding and subtracting (inclusion and exclusion).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import sqrt
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions.distance import lone
from farpoint.operators.numbering import running_total
from farpoint.operators.windows import with_slides
from farpoint.specs import Attr, WindowSpec, used_attrs

MAX_NOMINAL = 2
_BELOW, _DATA, _ABOVE = 0, 1, 2


def countable(attrs: list[Attr]) -> bool:
    """One numeric attribute and few nominal ones."""
    used = used_attrs(attrs)
    return sum(a.numeric for a in used) == 1 and sum(not a.numeric for a in used) <= MAX_NOMINAL


def _subsets(names: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for size in range(len(names) + 1) for c in combinations(names, size)]


def _gap(radius: float, differing: int) -> float:
    """Largest numeric gap within the radius when ``differing`` nominal attributes differ."""
    low, high = 0.0, 2.0 * radius + 1.0
    while True:
        middle = (low + high) / 2.0
        if middle in (low, high):
            return low
        if sqrt(middle * middle + differing) <= radius:
            low = middle
        else:
            high = middle


def _terms(nominal: Sequence[str], radius: float) -> list[tuple[tuple[str, ...], float, int]]:
    """(attributes required equal, numeric gap, weight) whose weighted counts add up to the neighbours."""
    weights: dict[tuple[tuple[str, ...], float], int] = {}
    for differing in _subsets(nominal):
        if len(differing) > radius * radius:
            continue
        gap = _gap(radius, len(differing))
        agreeing = [n for n in nominal if n not in differing]
        for back in _subsets(differing):
            equal = tuple(n for n in nominal if n in agreeing or n in back)
            weights[equal, gap] = weights.get((equal, gap), 0) + (-1) ** len(back)
    return [(equal, gap, w) for (equal, gap), w in weights.items() if w]


def _bound(value: Column, step: float, lower: bool) -> tuple[Column, Column]:
    """Place of ``value + step`` in the order: its nearest double, and before or after equal data.

    The rounding error of the sum is recovered exactly and decides about data that equals the
    rounded bound.
    """
    s = F.lit(step)
    total = value + s
    part = total - value
    error = (value - (total - part)) + (s - part)
    counted = error <= 0 if lower else error >= 0
    first, second = (_BELOW, _ABOVE) if lower else (_ABOVE, _BELOW)
    return total, F.when(counted, first).otherwise(second)


def _rows(attrs: list[Attr], radius: float) -> tuple[Column, Column, list[str]]:
    """Arrays of data rows and of interval bounds per point, and the columns that group them.

    Where an attribute is required equal, a point with NULL there has no rows, since NULL equals nothing.
    """
    used = used_attrs(attrs)
    value = F.col(f"`{next(a.name for a in used if a.numeric)}`").cast("double")
    nominal = [a.name for a in used if not a.numeric]
    terms = _terms(nominal, radius)
    groupings = sorted({equal for equal, _, _ in terms})
    groups = ["_set", *[f"_g{i}" for i in range(len(nominal))]]

    def row(equal: tuple[str, ...], x: Column, kind: Column, weight: int) -> Column:
        required = [F.when(F.lit(n in equal), F.col(f"`{n}`")).alias(f"_g{i}") for i, n in enumerate(nominal)]
        kept = [F.lit(groupings.index(equal)).alias("_set"), *required]
        made = F.struct(*kept, x.alias("_x"), kind.cast("int").alias("_kind"), F.lit(weight).alias("_weight"))
        known = reduce(and_, [F.col(f"`{n}`").isNotNull() for n in equal], F.lit(True))
        return F.when(known, made)

    data = F.array(*[row(equal, value, F.lit(_DATA), 0) for equal in groupings])
    bounds = []
    for equal, gap, weight in terms:
        bounds.append(row(equal, *_bound(value, gap, lower=False), weight))
        bounds.append(row(equal, *_bound(value, -gap, lower=True), -weight))
    return F.array_compact(data), F.array_compact(F.array(*bounds)), groups


def ordered_counts(vectors: DataFrame, attrs: list[Attr], radius: float, weight: str, name: str) -> DataFrame:
    """``vectors`` (distinct attribute values) with the total ``weight`` of all vectors within the radius.

    None of them may be lone, see :func:`farpoint.functions.distance.lone`.
    """
    data, bounds, groups = _rows(attrs, radius)
    names = [a.name for a in used_attrs(attrs)]
    fields = [f"r.{c}" for c in (*groups, "_x", "_kind", "_weight")]
    kept = [F.col(f"`{n}`") for n in names]
    none = F.lit(0).cast("bigint")
    as_data = vectors.select(*kept, F.col(weight).alias("_n"), F.explode(data).alias("r")).select(*names, "_n", *fields)
    as_bounds = vectors.select(*kept, none.alias("_n"), F.explode(bounds).alias("r")).select(*names, "_n", *fields)
    rows = as_data.unionByName(as_bounds)
    counted = running_total(rows, "_n", ["_x", "_kind", *names, "_weight"], groups, "_below").where(F.col("_kind") != _DATA)
    return counted.groupBy(*kept).agg(F.sum(F.col("_weight") * F.col("_below")).alias(name))


def ordered_slide_counts(
    numbered: DataFrame,
    spec: WindowSpec,
    attrs: list[Attr],
    radius: float,
    key: Sequence[str],
    point: Sequence[str],
    probes: DataFrame | None = None,
) -> DataFrame:
    """Neighbours of each point per slide in reach, itself included: columns ``point``, nb_slide, _near.

    Values are sorted per slide, so a sort group holds one slide and the bounds that look at it. Points
    without any neighbour for their NULL or NaN attributes have a row for themselves only.
    """
    data, bounds, groups = _rows(attrs, radius)
    points = with_slides(numbered, spec)
    searched = points if probes is None else with_slides(probes, spec)
    apart = lone(attrs, radius)
    alone = searched.where(apart)
    points, searched = points.where(~apart), searched.where(~apart)
    fields = [f"r.{c}" for c in (*groups, "_x", "_kind", "_weight")]
    columns = [F.col(f"`{c}`") for c in point]
    last = F.floor((F.col("stream_rows") - 1) / spec.slide).cast("bigint")
    reach = F.sequence(
        F.greatest(F.col("slide_id") - (spec.panes - 1), F.lit(0).cast("bigint")),
        F.least(F.col("slide_id") + (spec.panes - 1), last),
    )
    as_bounds = (
        searched.select(*columns, F.explode(bounds).alias("r"), reach.alias("_reach"))
        .withColumn("nb_slide", F.explode("_reach"))
        .select(*columns, "nb_slide", *fields)
    )
    as_data = points.select(*columns, F.col("slide_id").alias("nb_slide"), F.explode(data).alias("r"))
    rows = as_data.select(*columns, "nb_slide", *fields).unionByName(as_bounds)
    so_far = (
        Window.partitionBy(*key, "nb_slide", *groups)
        .orderBy("_x", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    below = F.sum((F.col("_kind") == _DATA).cast("bigint")).over(so_far)
    counted = rows.withColumn("_below", below).where(F.col("_kind") != _DATA)
    parts = counted.select(*columns, "nb_slide", (F.col("_weight") * F.col("_below")).alias("_part"))
    parts = parts.unionByName(alone.select(*columns, F.col("slide_id").alias("nb_slide"), F.lit(1).cast("bigint").alias("_part")))
    counts = parts.groupBy(*columns, "nb_slide").agg(F.sum("_part").alias("_near"))
    return counts.where("_near > 0")
