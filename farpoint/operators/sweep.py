"""Parameter sweeps over window width, radius and neighbour count in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.functions.status import OUTLIER, SAFE, UNSAFE, classify
from farpoint.operators.evidence import SlideCounts, counts_per_window
from farpoint.operators.neighbors import block_pairs
from farpoint.specs import Attr, WindowSpec


def sweep(
    numbered: DataFrame,
    widths: Sequence[int],
    slide: int,
    attrs: list[Attr],
    radii: Sequence[float],
    ks: Sequence[int],
    key: Sequence[str] = (),
) -> DataFrame:
    """Points per status for every width, radius, ``k`` and full window.

    Neighbours are searched once, at the greatest width and radius. Counts per slide are kept for
    each radius and reused for all widths, and ``k`` only enters the final comparison.
    """
    widest = WindowSpec(max(widths), slide)
    pairs = block_pairs(numbered, widest, attrs, max(radii), key)
    within = lambda r: F.count_if(F.col("distance") <= F.lit(float(r)))
    counts = pairs.df.groupBy(*pairs.point, "nb_slide").agg(*[within(r).alias(f"_r{i}") for i, r in enumerate(radii)])
    per_radius = F.explode(
        F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"_r{i}").alias("n")) for i, r in enumerate(radii)])
    )
    long = counts.select(*pairs.point, "nb_slide", per_radius.alias("_c")).select(
        *pairs.point, "nb_slide", F.col("_c.radius").alias("radius"), F.col("_c.n").alias("_near")
    )
    settings = F.array(*[F.lit(int(w)) for w in sorted(set(widths))])
    panes = F.floor(F.col("width") / slide)
    near = (
        long.where("_near > 0")
        .withColumn("width", F.explode(settings))
        .where(F.abs(F.col("nb_slide") - F.col("slide_id")) < panes)
    )
    results = counts_per_window(
        SlideCounts(near, pairs.place, pairs.point), widest, extra=["width", "radius"], panes=panes
    )
    judged = results.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).withColumn(
        "status", classify("succ", "prev", F.col("k"))
    )
    count = lambda value, name: F.count_if(F.col("status") == value).alias(name)
    return judged.groupBy(*key, "width", "radius", "k", "window_id").agg(
        F.count("*").alias("points"), count(SAFE, "safe"), count(UNSAFE, "unsafe"), count(OUTLIER, "outliers")
    )
