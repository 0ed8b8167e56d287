"""Neighbour search among numbered points: pairs within a radius inside one sliding window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions.distance import mixed_distance
from farpoint.operators.windows import with_slides
from farpoint.specs import Attr, WindowSpec, used_attrs

# Points of one search block. Blocks are runs of consecutive positions, so their size, and with it
# the work of one join key, is bounded by the window and not by the data.
MIN_BLOCK, MAX_BLOCK = 256, 4096

# Points searched by one task. A point costs a few KB there (what it meets, its counts and their changes), so tasks
# grow in number with the points, whatever the bytes they are shuffled as.
TASK_POINTS = 25_000
# Slides of a window up to which that holds. With more of them a point has as many more counts or changes, and a task as many fewer points.
TASK_PANES = 40

# A sort-merge join keeps the counts of a point in the partition of its join key and spills when a
# partition is large.
JOIN = "merge"

# Bin edges are computed in double arithmetic; searching a hair further than the radius keeps pairs
# exactly on the radius in reach. The distance test itself is exact.
_SLACK = 1.0 + 1e-9


def value_bin(value: Column, radius: float, times: int = 1) -> Column:
    """Bin of a value on a grid of twice the radius, or ``times`` that."""
    return F.coalesce(F.floor(value.cast("double") / _bin_width(radius, times)), F.lit(-(1 << 62)))


def bins_in_reach(value: Column, radius: float, times: int = 1) -> Column:
    """All bins that hold a value within the radius: two on average, fewer if they are wider."""
    value, reach, width = value.cast("double"), F.lit(radius * _SLACK), _bin_width(radius, times)
    bins = F.sequence(F.floor((value - reach) / width), F.floor((value + reach) / width))
    return F.coalesce(bins, F.array(F.lit(-(1 << 62)).cast("bigint")))


def _bin_width(radius: float, times: int = 1) -> Column:
    return F.lit((2.0 * radius if radius > 0 else 1.0) * times)


@dataclass(frozen=True)
class Search:
    """How the distance is split into equality keys, one binned attribute and an exact test."""

    attrs: list[Attr]
    radius: float

    @property
    def equal(self) -> list[str]:
        """Nominal attributes that must agree: below radius 1 a single difference is too far."""
        return [a.name for a in used_attrs(self.attrs) if not a.numeric] if self.radius < 1 else []

    @property
    def measured(self) -> list[Attr]:
        return [a for a in used_attrs(self.attrs) if a.name not in self.equal]

    @property
    def binned(self) -> str | None:
        return next((a.name for a in used_attrs(self.attrs) if a.numeric), None)

    def own_bin(self) -> Column:
        return value_bin(F.col(f"`{self.binned}`"), self.radius) if self.binned else F.lit(0).cast("bigint")

    def reachable_bins(self) -> Column:
        if self.binned is None:
            return F.array(F.lit(0).cast("bigint"))
        return bins_in_reach(F.col(f"`{self.binned}`"), self.radius)

    def distance(self) -> Column:
        return mixed_distance(self.measured)


@dataclass(frozen=True)
class BlockPairs:
    """Pairs within the radius, co-located by block.

    ``df`` has the columns of ``point`` (one searched point), then ``nb_seq``, ``nb_slide`` and
    ``distance``. Every pair of a point is in the partition given by ``place``, which is part of
    ``point``, so grouping by ``point`` needs no further shuffle. Each point is its own neighbour
    at distance 0, so none is lost.
    """

    df: DataFrame
    place: list[str]
    point: list[str]


def block_pairs(
    numbered: DataFrame,
    spec: WindowSpec,
    attrs: list[Attr],
    radius: float,
    key: Sequence[str] = (),
    carry: Sequence[str] = (),
    probes: DataFrame | None = None,
    rows: int | None = None,
) -> BlockPairs:
    """Join each point with the points within ``radius`` that share a sliding window with it.

    A point is searched once, in its own block and bin; the points it may meet are copied to the
    blocks in reach (2.5 copies on average while the window fits a block) and to about two bins.
    ``probes`` limits the searched points; all of ``numbered`` is searched otherwise. ``rows`` is the number of
    points if it is known; it sets the number of tasks.
    """
    search = Search(attrs, radius)
    panes, slide = spec.panes, spec.slide
    block_rows = min(max(spec.points, MIN_BLOCK), MAX_BLOCK)
    # One value for the key and what must agree: unlike its parts it is never NULL.
    match = [F.struct(*[F.col(f"`{n}`") for n in [*key, *search.equal]]).alias("_match")] if key or search.equal else []
    meeting = ["_block", "_bin", *["_match" for _ in match]]
    place = [*key, *meeting]
    names = [a.name for a in used_attrs(attrs)]
    points = with_slides(numbered, spec)
    searched = points if probes is None else with_slides(probes, spec)
    extra = [c for c in carry if c not in names and c not in key]

    left = searched.select(
        *key,
        "seq",
        "slide_id",
        "stream_rows",
        *extra,
        *[F.col(f"`{n}`") for n in names],
        F.floor((F.col("seq") - 1) / block_rows).cast("bigint").alias("_block"),
        search.own_bin().alias("_bin"),
        *match,
    )
    first = F.greatest(F.floor((F.col("slide_id") - (panes - 1)) * slide / block_rows), F.lit(0)).cast("bigint")
    last = F.floor(((F.col("slide_id") + panes) * slide - 1) / block_rows).cast("bigint")
    right = (
        points.select(
            *match,
            F.col("seq").alias("nb_seq"),
            F.col("slide_id").alias("nb_slide"),
            *[F.col(f"`{n}`").alias(f"b_{n}") for n in names if n not in search.equal],
            F.sequence(first, last).alias("_blocks"),
            search.reachable_bins().alias("_bins"),
        )
        .withColumn("_block", F.explode("_blocks"))
        .withColumn("_bin", F.explode("_bins"))
        .drop("_blocks", "_bins")
    )
    left, right = _spread(left, right, meeting, numbered.count() if rows is None else rows, panes)
    same = F.col("seq") == F.col("nb_seq")
    known = reduce(and_, [F.col(f"`{n}`").isNotNull() for n in search.equal], F.lit(True))
    pairs = left.join(right.hint(JOIN), meeting).where(
        (F.abs(F.col("nb_slide") - F.col("slide_id")) < panes)
        & (same | (known & (search.distance() <= F.lit(float(radius)))))
    )
    point = list(dict.fromkeys([*place, "seq", "slide_id", "stream_rows", *carry]))
    df = pairs.select(*[F.col(f"`{c}`") for c in point], "nb_seq", "nb_slide", search.distance().alias("distance"))
    return BlockPairs(df, place, point)


def _spread(left: DataFrame, right: DataFrame, meeting: list[str], rows: int, panes: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join in enough partitions for that many points; as Spark chooses if one task can have all."""
    most = max(1, TASK_POINTS * TASK_PANES // max(panes, TASK_PANES))
    if rows <= most:
        return left, right
    tasks = max(-(-rows // most), left.sparkSession.sparkContext.defaultParallelism)
    return left.repartition(tasks, *meeting), right.repartition(tasks, *meeting)


def window_pairs(
    numbered: DataFrame, spec: WindowSpec, attrs: list[Attr], radius: float, key: Sequence[str] = ()
) -> DataFrame:
    """Ordered pairs of different points within the radius that share a window."""
    pairs = block_pairs(numbered, spec, attrs, radius, key)
    return pairs.df.where("seq <> nb_seq").select(*key, "seq", "slide_id", "nb_seq", "nb_slide", "distance")


def remove_points(points: DataFrame, removed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Points without those listed in ``removed``."""
    return points.join(removed.select(*on), list(on), "left_anti")


def live_points(numbered: DataFrame, at_seq: int | Column, width: int) -> DataFrame:
    """Points of the window of ``width`` points that ends at position ``at_seq``."""
    at = F.lit(at_seq) if isinstance(at_seq, int) else at_seq
    return numbered.where((F.col("seq") <= at) & (F.col("seq") > at - width))
