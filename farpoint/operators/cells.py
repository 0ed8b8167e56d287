"""Grid cells whose members are all neighbours of each other: dense cells need no search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions.distance import mixed_distance
from farpoint.functions.status import OUTLIER
from farpoint.operators.evidence import window_status
from farpoint.operators.neighbors import MAX_BLOCK
from farpoint.operators.ranges import cell_columns
from farpoint.operators.windows import window_ids, with_slides
from farpoint.specs import Attr, OutlierParams, WindowSpec, used_attrs


def _cells(attrs: list[Attr]) -> list[str]:
    return [f"_c{i}" for i in range(len(used_attrs(attrs)))]


def in_cells(attrs: list[Attr], radius: float) -> Column:
    """True for points whose cell number is exact: values known, finite and not too many cells away from zero."""
    farthest = float(radius if radius > 0 else 1.0) * 2.0**40
    known = [
        F.coalesce(F.abs(F.col(f"`{a.name}`").cast("double")) < F.lit(farthest), F.lit(False)) if a.numeric else F.col(f"`{a.name}`").isNotNull()
        for a in used_attrs(attrs)
    ]
    return reduce(and_, known, F.lit(True))


def cell_outliers(
    numbered: DataFrame,
    spec: WindowSpec,
    attrs: list[Attr],
    params: OutlierParams,
    key: Sequence[str] = (),
    identity: Sequence[str] = (),
) -> DataFrame:
    """Outliers per window, the same as by full counting.

    A point whose cell holds more than ``k`` points of the window has ``k`` neighbours for sure.
    Only points that are in a sparser cell in at least one of their windows are searched. A point with a
    NULL, NaN or infinite attribute, or one beyond all numbered cells, is in no cell and always searched.
    """
    cells = _cells(attrs)
    every = with_slides(numbered, spec).select("*", *cell_columns(attrs, params.radius))
    celled = in_cells(attrs, params.radius)
    points = every.where(celled)
    per_slide = points.groupBy(*key, "slide_id", "stream_rows", *cells).agg(F.count("*").alias("_near"))
    in_window = Window.partitionBy(*key, "window_id", *cells)
    sparse = (
        per_slide.withColumn("window_id", F.explode(window_ids(spec)))
        .withColumn("_members", F.sum("_near").over(in_window))
        .where(F.col("_members") <= params.k)
        .select(*key, "slide_id", *cells)
        .distinct()
    )
    same = [F.col(f"p.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in [*key, "slide_id", *cells]]
    suspects = points.alias("p").join(sparse.alias("s"), same, "left_semi")
    suspects = suspects.unionByName(every.where(~celled)).drop(*cells, "slide_id")
    status = window_status(numbered, spec, attrs, params, key, identity, probes=suspects)
    return status.where(F.col("status") == OUTLIER)


def micro_clusters(
    numbered: DataFrame, spec: WindowSpec, attrs: list[Attr], radius: float, key: Sequence[str] = ()
) -> DataFrame:
    """Clusters (non-empty cells) per slide: size, first member as head, and radius around the head.

    ``cluster_id`` is the position of the head, which no other cluster shares. Points with a NULL, NaN or infinite
    attribute are near nothing and in no cluster.
    """
    cells = _cells(attrs)
    points = with_slides(numbered, spec).where(in_cells(attrs, radius)).select("*", *cell_columns(attrs, radius))
    attrs = used_attrs(attrs)
    # Nominal values are those of the cell; numeric ones are taken from its first member.
    first = [F.min_by(a.name, "seq").alias(f"_head_{a.name}") for a in attrs if a.numeric]
    # Numeric extremes bound the distance of any member from the head without a second pass.
    numeric = [a.name for a in attrs if a.numeric]
    spread = [e for n in numeric for e in (F.min(n).alias(f"_lo_{n}"), F.max(n).alias(f"_hi_{n}"))]
    clusters = points.groupBy(*key, "slide_id", "stream_rows", *cells).agg(
        F.count("*").alias("n"), F.min("seq").alias("cluster_id"), *first, *spread
    )
    gap = lambda n: F.greatest(F.col(f"_hi_{n}") - F.col(f"_head_{n}"), F.col(f"_head_{n}") - F.col(f"_lo_{n}"))
    reach = F.sqrt(sum((gap(n) * gap(n) for n in numeric), F.lit(0.0)))
    return clusters.select(
        *key,
        "slide_id",
        "stream_rows",
        "cluster_id",
        *[F.col(f"_head_{a.name}" if a.numeric else f"_c{i}").alias(a.name) for i, a in enumerate(attrs)],
        "n",
        reach.alias("radius"),
    )


def cluster_neighbors(
    numbered: DataFrame, spec: WindowSpec, attrs: list[Attr], radius: float, key: Sequence[str] = ()
) -> DataFrame:
    """Clusters of slides that share a window and may hold points within ``radius`` of each other.

    Two clusters are adjacent if their heads are no farther apart than the radius plus both cluster
    radii. That is at most three radii, which sets the bins of the join.
    """
    clusters = micro_clusters(numbered, spec, attrs, radius, key)
    names = [a.name for a in used_attrs(attrs)]
    binned = next((a.name for a in used_attrs(attrs) if a.numeric), None)
    far = 3.0 * radius * (1.0 + 1e-9)
    width = 2.0 * far if far > 0 else 1.0
    value = F.col(binned) if binned else F.lit(0.0)
    # One value for the key: unlike its parts it is never NULL.
    match = [F.struct(*key).alias("_match")] if key else []
    meeting = [*["_match" for _ in match], "_block", "_bin"]
    slides = max(1, MAX_BLOCK // spec.slide)
    panes = spec.panes
    left = clusters.select(
        *key, *match, "slide_id", "cluster_id", "radius", *names,
        F.floor(F.col("slide_id") / slides).alias("_block"), F.floor(value / width).alias("_bin"),
    )
    blocks = F.sequence(
        F.floor(F.greatest(F.col("slide_id") - (panes - 1), F.lit(0)) / slides),
        F.floor((F.col("slide_id") + (panes - 1)) / slides),
    )
    right = clusters.select(
        *match,
        F.col("slide_id").alias("nb_slide"),
        F.col("cluster_id").alias("nb_cluster"),
        F.col("radius").alias("_nb_radius"),
        *[F.col(n).alias(f"b_{n}") for n in names],
        blocks.alias("_blocks"),
        F.sequence(F.floor((value - far) / width), F.floor((value + far) / width)).alias("_bins"),
    )
    right = right.withColumn("_block", F.explode("_blocks")).withColumn("_bin", F.explode("_bins"))
    distance = mixed_distance(attrs)
    return (
        left.join(right.drop("_blocks", "_bins").hint("merge"), meeting)
        .where(F.abs(F.col("slide_id") - F.col("nb_slide")) < panes)
        .where(F.col("cluster_id") != F.col("nb_cluster"))
        .select(*key, "slide_id", "cluster_id", "nb_slide", "nb_cluster", distance.alias("distance"), "radius", "_nb_radius")
        .where(F.col("distance") <= F.lit(float(radius)) + F.col("radius") + F.col("_nb_radius"))
        .drop("radius", "_nb_radius")
    )
