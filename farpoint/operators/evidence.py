"""Neighbour evidence per slide and what is decided from it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions.status import OUTLIER, SAFE, UNSAFE, classify
from farpoint.operators.neighbors import BlockPairs, block_pairs
from farpoint.operators.ordered import countable, ordered_slide_counts
from farpoint.operators.windows import from_seq, full_slides, to_seq, window_ids
from farpoint.specs import Attr, OutlierParams, WindowSpec

# Slides from this size on are counted in order rather than by pairs, if the attributes allow it.
ORDERED_SLIDE = 4096


@dataclass(frozen=True)
class SlideCounts:
    """Neighbours of each point per slide; ``_near`` counts the point itself in its own slide.

    Columns of its own are prefixed, so that identity columns may have any other name.
    """

    df: DataFrame
    place: list[str]
    point: list[str]


def count_slides(pairs: BlockPairs) -> SlideCounts:
    return SlideCounts(
        pairs.df.groupBy(*pairs.point, "nb_slide").agg(F.count("*").alias("_near")), pairs.place, pairs.point
    )


def slide_counts(
    numbered: DataFrame,
    spec: WindowSpec,
    attrs: list[Attr],
    radius: float,
    key: Sequence[str] = (),
    carry: Sequence[str] = (),
    probes: DataFrame | None = None,
    method: str = "auto",
) -> SlideCounts:
    """Neighbours of each point in each slide in reach.

    ``pairs`` compares points block by block, which suits small windows and any attributes.
    ``ordered`` counts on sorted values and never forms pairs; it needs a single numeric attribute
    and is the choice of ``auto`` for large slides.
    """
    if method == "auto":
        method = "ordered" if spec.slide >= ORDERED_SLIDE and countable(attrs) else "pairs"
    if method == "pairs":
        return count_slides(block_pairs(numbered, spec, attrs, radius, key, carry, probes))
    if method != "ordered" or not countable(attrs):
        raise ValueError(f"method {method} does not apply to these attributes")
    point = list(dict.fromkeys([*key, "seq", "slide_id", "stream_rows", *carry]))
    return SlideCounts(
        ordered_slide_counts(numbered, spec, attrs, radius, key, point, probes), [*key, "seq"], point
    )


def window_evidence(
    numbered: DataFrame, spec: WindowSpec, attrs: list[Attr], radius: float, key: Sequence[str] = ()
) -> DataFrame:
    """Neighbours of each point in each slide it can share a window with, itself excluded."""
    own = (F.col("nb_slide") == F.col("slide_id")).cast("bigint")
    counts = slide_counts(numbered, spec, attrs, radius, key).df
    return counts.select(*key, "seq", "slide_id", "nb_slide", (F.col("_near") - own).alias("n")).where("n > 0")


def _changes(panes: Column) -> Column:
    """Count changes of a point, by number of slides after its own.

    A later slide adds to ``succ`` when it arrives. An earlier slide is in ``prev`` from the start
    and leaves when the window has moved on by ``panes``. The own slide yields one row per window,
    so that windows without any change are there as well.
    """
    d, n = F.col("nb_slide") - F.col("slide_id"), F.col("_near")
    zero = F.lit(0).cast("bigint")

    def change(step: Column, succ: Column, prev: Column) -> Column:
        return F.struct(step.cast("bigint").alias("step"), succ.alias("succ"), prev.alias("prev"))

    own = F.transform(
        F.sequence(zero, panes.cast("bigint") - 1),
        lambda j: change(j, F.when(j == 0, n - 1).otherwise(zero), zero),
    )
    return F.explode(
        F.when(d == 0, own)
        .when(d > 0, F.array(change(d, n, zero)))
        .otherwise(F.array(change(zero, zero, n), change(d + panes, zero, -n)))
    )


def counts_per_window(
    counts: SlideCounts, spec: WindowSpec, extra: Sequence[str] = (), panes: Column | None = None
) -> DataFrame:
    """``succ`` and ``prev`` of each point in each full window, from counts per slide.

    With ``extra`` columns the rows hold several settings; ``panes`` may then differ per row.

    Linear in the slides of a window: changes per slide, summed up in order. All steps group by
    the place of the point, so they run in the stage of the neighbour join.
    """
    point = [*counts.point, *extra]
    panes = F.lit(spec.panes) if panes is None else panes
    steps = (
        counts.df.select(*point, _changes(panes).alias("_c"))
        .groupBy(*point, F.col("_c.step").alias("_step"))
        .agg(F.sum("_c.succ").alias("_ds"), F.sum("_c.prev").alias("_dp"))
    )
    so_far = (
        Window.partitionBy(*dict.fromkeys([*counts.place, "seq", *extra]))
        .orderBy("_step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = steps.withColumn("succ", F.sum("_ds").over(so_far)).withColumn("prev", F.sum("_dp").over(so_far))
    window_id = F.col("slide_id") + F.col("_step")
    return summed.withColumn("window_id", window_id).where(
        (F.col("window_id") >= panes - 1) & (F.col("window_id") < full_slides(spec))
    )


def window_status(
    numbered: DataFrame,
    spec: WindowSpec,
    attrs: list[Attr],
    params: OutlierParams,
    key: Sequence[str] = (),
    identity: Sequence[str] = (),
    probes: DataFrame | None = None,
    method: str = "auto",
) -> DataFrame:
    """Neighbour counts and status of every point in every full window."""
    counts = slide_counts(numbered, spec, attrs, params.radius, key, identity, probes, method)
    status = classify("succ", "prev", params.k).alias("status")
    return counts_per_window(counts, spec).select(*key, "window_id", "seq", *identity, "succ", "prev", status)


def window_report(
    numbered: DataFrame,
    spec: WindowSpec,
    attrs: list[Attr],
    params: OutlierParams,
    key: Sequence[str] = (),
    identity: Sequence[str] = (),
    only_outliers: bool = False,
) -> DataFrame:
    """Report per window: range, identity columns, status and number of neighbours."""
    status = window_status(numbered, spec, attrs, params, key, identity)
    if only_outliers:
        status = status.where(F.col("status") == OUTLIER)
    return status.select(
        *key,
        "window_id",
        from_seq(spec).alias("from_seq"),
        to_seq(spec).alias("to_seq"),
        "seq",
        *identity,
        "succ",
        "prev",
        "status",
        (F.col("succ") + F.col("prev")).alias("n_neighbors"),
    )


def outlier_counts(status: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Points per window and how many have each status."""
    count = lambda value, name: F.count_if(F.col("status") == value).alias(name)
    return status.groupBy(*key, "window_id").agg(
        F.count("*").alias("points"), count(SAFE, "safe"), count(UNSAFE, "unsafe"), count(OUTLIER, "outliers")
    )


def observed(status: DataFrame, name: str = "window_metrics") -> DataFrame:
    """Attach run metrics (rows and outliers) that Spark reports when an action runs."""
    return status.observe(
        name, F.count("*").alias("rows"), F.count_if(F.col("status") == OUTLIER).alias("outliers")
    )


def _at_most(sorted_values: Column, x: Column, most: int) -> Column:
    """How many of at most ``most`` ascending values are not above ``x``, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])

    def further(at: Column, step: Column) -> Column:
        fits = F.coalesce(F.get(sorted_values, at + step - 1) <= x, F.lit(False))
        return F.when(fits, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def _undecided(
    numbered: DataFrame, spec: WindowSpec, attrs: list[Attr], params: OutlierParams, key: Sequence[str], shown
) -> DataFrame:
    """Windows of points that are not Safe, with what ``shown`` makes of the evidence, for points that have any.

    A point's counts per slide become two arrays, slides and running sums. In each window its counts are differences of
    sums, and the slide where the walk from the newest earlier slide back reaches ``k`` is found by bisection, so a window costs a
    logarithm of its slides. ``shown`` gets slides, sums before and after each, and the places from where to where they count.
    """
    counts = slide_counts(numbered, spec, attrs, params.radius, key)
    in_order = Window.partitionBy(*dict.fromkeys([*counts.place, "seq"])).orderBy("nb_slide")
    summed = counts.df.withColumn("_sum", F.sum("_near").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    arrays = summed.groupBy(*counts.point).agg(F.array_sort(F.collect_list(F.struct("nb_slide", "_sum"))).alias("_s"))
    profile = arrays.select(*counts.point, F.col("_s.nb_slide").alias("_slides"), F.col("_s._sum").alias("_sums"))
    slides, sums, most = F.col("_slides"), F.col("_sums"), 2 * spec.panes
    up_to = lambda at: F.coalesce(F.get(sums, at - 1), F.lit(0).cast("bigint"))
    profile = profile.withColumn("_own", _at_most(slides, F.col("slide_id") - 1, most)).withColumn("_before", up_to(F.col("_own")))
    own, before = F.col("_own"), F.col("_before")

    def in_window(w: Column) -> Column:
        succ = up_to(_at_most(slides, w, most)) - before - 1
        first = _at_most(slides, w - spec.panes, most)
        stop = F.greatest(_at_most(sums, succ + before - params.k, most), first)
        prev = before - up_to(first)
        return F.struct(w.alias("window_id"), succ.alias("succ"), prev.alias("prev"), stop.alias("stop"))

    windows = F.filter(F.transform(window_ids(spec), in_window), lambda v: (v.succ < params.k) & (v.stop < own))
    made = F.transform(windows, lambda v: F.struct(v.window_id.alias("window_id"), classify(v.succ, v.prev, params.k).alias("status"), shown(v, slides, up_to, own, before).alias("shown")))
    return profile.select(*key, "seq", F.explode(made).alias("_w")).select(*key, "seq", "_w.*")


def minimal_evidence(
    numbered: DataFrame, spec: WindowSpec, attrs: list[Attr], params: OutlierParams, key: Sequence[str] = ()
) -> DataFrame:
    """Slides that suffice to decide a point that is not Safe, with the count reached after each."""

    def walked(v: Column, slides: Column, up_to, own: Column, before: Column) -> Column:
        places = F.sequence(v.stop, own - 1)
        return F.transform(
            places,
            lambda i: F.struct(
                F.get(slides, i).alias("nb_slide"), (up_to(i + 1) - up_to(i)).alias("n"), (v.succ + before - up_to(i)).alias("found")
            ),
        )

    walks = _undecided(numbered, spec, attrs, params, key, walked).withColumn("_e", F.explode("shown"))
    return walks.select(*key, "window_id", "seq", "_e.nb_slide", "_e.n", "_e.found", "status")


def trigger_slide(
    numbered: DataFrame, spec: WindowSpec, attrs: list[Attr], params: OutlierParams, key: Sequence[str] = ()
) -> DataFrame:
    """For Unsafe points the oldest slide used as evidence: its expiry calls for a new check."""
    stops = _undecided(numbered, spec, attrs, params, key, lambda v, slides, up_to, own, before: F.get(slides, v.stop))
    return stops.where(F.col("status") == UNSAFE).select(*key, "window_id", "seq", F.col("shown").alias("trigger_slide"))


def due_checks(triggers: DataFrame, expired: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Points to check again because a slide of ``expired`` (column ``slide_id``) served as evidence."""
    due = triggers.select(*key, F.col("trigger_slide").alias("slide_id"), "seq").distinct()
    same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"x.`{c}`")) for c in [*key, "slide_id"]]
    return due.alias("d").join(expired.select(*key, "slide_id").alias("x"), same, "left_semi")


def _arrival_pairs(
    numbered: DataFrame, width: int, attrs: list[Attr], radius: float, key: Sequence[str]
) -> BlockPairs:
    """Pairs that are ever together in the last ``width`` points, judged point by point."""
    return block_pairs(numbered, WindowSpec(width, 1), attrs, radius, key)


def preceding_neighbors(
    numbered: DataFrame, width: int, attrs: list[Attr], radius: float, key: Sequence[str] = ()
) -> DataFrame:
    """Ids of the neighbours present when a point arrives (at most ``width - 1`` of them)."""
    pairs = _arrival_pairs(numbered, width, attrs, radius, key)
    earlier = F.when(F.col("nb_seq") < F.col("seq"), F.col("nb_seq"))
    lists = pairs.df.groupBy(*pairs.point).agg(F.sort_array(F.collect_list(earlier)).alias("pre_neighbors"))
    return lists.select(*key, "seq", "pre_neighbors")


def next_check(
    numbered: DataFrame, width: int, attrs: list[Attr], params: OutlierParams, key: Sequence[str] = ()
) -> DataFrame:
    """When a point with at least ``k`` neighbours at arrival must be looked at again.

    That is when its k-th youngest neighbour expires, unless later arrivals have replaced it.
    """
    k = params.k
    lists = preceding_neighbors(numbered, width, attrs, params.radius, key)
    enough = lists.where(F.size("pre_neighbors") >= k)
    kth_youngest = F.element_at("pre_neighbors", -k)
    return enough.select(
        *key,
        "seq",
        F.size("pre_neighbors").cast("bigint").alias("n_prev"),
        (kth_youngest + width).alias("check_seq"),
    )


def check_schedule(
    numbered: DataFrame, width: int, attrs: list[Attr], params: OutlierParams, key: Sequence[str] = ()
) -> DataFrame:
    """All checks of each point in the window of the last ``width`` points, and the status each finds.

    A point is checked when it arrives. If its neighbours suffice, the next check is due when the (k - succ)-th youngest
    earlier neighbour expires, for then enough later ones must have come. Checks end with Safe, Outlier or the stream. Between two checks
    ``succ`` must have grown, so there are at most k + 1 of them, and the k youngest earlier and the k first later neighbours
    decide all.
    """
    k = params.k
    pairs = _arrival_pairs(numbered, width, attrs, params.radius, key)
    some = lambda column, newest: F.slice(F.sort_array(F.collect_list(column), asc=not newest), 1, k)
    seq, nb = F.col("seq"), F.col("nb_seq")
    lists = pairs.df.groupBy(*pairs.point).agg(
        some(F.when(nb < seq, nb), True).alias("_earlier"), some(F.when(nb > seq, nb), False).alias("_later")
    )

    def check(at: Column) -> Column:
        succ = F.size(F.filter("_later", lambda x: x <= at))
        deciding = F.get("_earlier", F.lit(k - 1) - succ)
        enough = F.coalesce(deciding > at - width, F.lit(False))
        status = F.when(succ >= k, SAFE).when(enough, UNSAFE).otherwise(OUTLIER)
        return F.struct(at.alias("check_seq"), status.alias("status"), F.when(enough & (succ < k), deciding + width).alias("next"))

    def following(checks: Column, _: Column) -> Column:
        due = F.element_at(checks, -1).next
        return F.when(due <= F.col("stream_rows"), F.concat(checks, F.array(check(due)))).otherwise(checks)

    checks = F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array(check(seq)), following)).alias("_c")
    return lists.select(*key, "seq", checks).select(*key, "seq", "_c.check_seq", "_c.status")


def status_timeline(
    numbered: DataFrame, width: int, attrs: list[Attr], params: OutlierParams, key: Sequence[str] = ()
) -> DataFrame:
    """Status changes of each point while it is in the window of the last ``width`` points.

    A neighbour that arrives adds to ``succ``; one that was there first leaves ``prev`` when it
    expires. Both are events on the position axis, summed up in order per point.
    """
    pairs = _arrival_pairs(numbered, width, attrs, params.radius, key)
    seq, nb = F.col("seq"), F.col("nb_seq")

    def event(at: Column, succ: int, prev: int) -> Column:
        return F.struct(
            at.alias("at_seq"), F.lit(succ).cast("bigint").alias("succ"), F.lit(prev).cast("bigint").alias("prev")
        )

    events = F.explode(
        F.when(nb == seq, F.array(event(seq, 0, 0)))
        .when(nb > seq, F.array(event(nb, 1, 0)))
        .otherwise(F.array(event(seq, 0, 1), event(nb + width, 0, -1)))
    )
    per_position = (
        pairs.df.select(*pairs.point, events.alias("_e"))
        .where(F.col("_e.at_seq") <= F.col("stream_rows"))
        .groupBy(*pairs.place, "seq", F.col("_e.at_seq").alias("at_seq"))
        .agg(F.sum("_e.succ").alias("_ds"), F.sum("_e.prev").alias("_dp"))
    )
    in_order = Window.partitionBy(*pairs.place, "seq").orderBy("at_seq")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timeline = (
        per_position.withColumn("succ", F.sum("_ds").over(so_far))
        .withColumn("prev", F.sum("_dp").over(so_far))
        .withColumn("status", classify("succ", "prev", params.k))
        .withColumn("_before", F.lag("status").over(in_order))
    )
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("status"))
    return timeline.where(changed).select(*key, "seq", "at_seq", "succ", "prev", "status")
