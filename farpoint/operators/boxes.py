"""Bounding boxes: checks, tiling, median partitioning and intersection joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions.boxes import AXES, boxes_intersect, is_valid_box, regions_intersect
from farpoint.operators.numbering import BROADCAST_ROWS, number_rows, running_total
from farpoint.operators.skew import GROUP_ROWS, salted_join, salted_sides
from farpoint.session import materialize, release

BOX = ["id", *AXES]

# Pairs that one task compares when it is to hold all hits of its queries.
TASK_PAIRS = 50_000_000
_HOME = ["_cx", "_cy", "_ls", "_rs"]
# Largest cell side whose corners are counted place by place, which bounds the different boxes of a cell, and cells that are counted at a time.
COUNT_SIDE, COUNT_CELLS = 32, 256
_CORNERS = [("xMin", "yMin"), ("xMax", "yMax"), ("xMin", "yMax"), ("xMax", "yMin")]
# Queries of a block that gets all boxes it may meet, and pairs that are compared at a time there.
BLOCK_QUERIES, BLOCK_PAIRS, TILE_QUERIES = 2_000, 4_000_000, 64


def validate_boxes(boxes: DataFrame, on_error: str = "raise") -> DataFrame:
    """Require xMin < xMax and yMin < yMax: ``raise`` at run time, or ``drop`` / ``only`` the bad rows."""
    valid = F.coalesce(is_valid_box(), F.lit(False))
    if on_error == "raise":
        message = F.concat(F.lit("illegal bounding box "), F.to_json(F.struct(*BOX)))
        return boxes.withColumn("xMin", F.when(valid, F.col("xMin")).otherwise(F.raise_error(message).cast("bigint")))
    if on_error == "drop":
        return boxes.where(valid)
    if on_error == "only":
        return boxes.where(~valid)
    raise ValueError(f"on_error must be raise, drop or only, not {on_error}")


def translate_boxes(boxes: DataFrame, x: Column, y: Column, id_offset: Column) -> DataFrame:
    """Boxes moved by (x, y), with ids moved by ``id_offset``."""
    moved = {"id": F.col("id") + id_offset, "xMin": F.col("xMin") + x, "xMax": F.col("xMax") + x}
    moved |= {"yMin": F.col("yMin") + y, "yMax": F.col("yMax") + y}
    return boxes.select(*[moved[c].alias(c) for c in BOX])


def extent(boxes: DataFrame) -> DataFrame:
    """Outer bounds of all boxes, and their sides enlarged by one unit."""
    bounds = boxes.agg(
        F.min("xMin").alias("xMin"), F.min("yMin").alias("yMin"),
        F.max("xMax").alias("xMax"), F.max("yMax").alias("yMax"), F.count("*").alias("boxes"),
    )
    return bounds.select(
        "*", (F.col("xMax") - F.col("xMin") + 1).alias("xExtent"), (F.col("yMax") - F.col("yMin") + 1).alias("yExtent")
    )


def tile_boxes(boxes: DataFrame, copies: int) -> DataFrame:
    """``copies`` x ``copies`` instances side by side that do not touch, with new ids.

    The ids of the input are 0..N-1, or at least below N.
    """
    size = extent(boxes).first()
    steps = F.sequence(F.lit(0), F.lit(copies - 1)).cast("array<bigint>")
    placed = boxes.withColumn("_row", F.explode(steps)).withColumn("_col", F.explode(steps))
    offset = (F.col("_row") * copies + F.col("_col")) * F.lit(size["boxes"])
    return translate_boxes(placed, F.col("_col") * F.lit(size["xExtent"]), F.col("_row") * F.lit(size["yExtent"]), offset)


def _grid(queries: DataFrame, boxes: DataFrame, cell: int | None) -> tuple[int, int]:
    """Side of the finest cells (a power of two, about twice the usual box side) and the top level."""
    side = F.greatest(F.col("xMax") - F.col("xMin"), F.col("yMax") - F.col("yMin"), F.lit(1))
    sizes = [df.agg(F.avg(side), F.max(side)).first() for df in (queries, boxes)]
    usual = max((average or 1.0) for average, _ in sizes)
    widest = max((largest or 1) for _, largest in sizes)
    if cell is None:
        cell = 1 << max(1, ceil(log2(2.0 * usual)))
    return cell, max(0, ceil(log2(widest / cell)))


def _level(cell: int) -> Column:
    """Grid level at which a box covers at most 2 x 2 cells: level L has cells of side cell * 2^L."""
    side = F.greatest(F.col("xMax") - F.col("xMin"), F.col("yMax") - F.col("yMin"), F.lit(1))
    return F.greatest(F.ceil(F.log2(side / F.lit(cell))), F.lit(0)).cast("int")  # same rule as _grid


def _in_cells(boxes: DataFrame, top: int, query: bool, cell: int) -> DataFrame:
    """Boxes copied to the cells they cover on each grid where they are to meet others."""
    if top == 0:
        placed = boxes.withColumn("_level", F.lit(0)).withColumn("_role", F.lit("a"))
        size = F.lit(float(cell))
    else:
        placed = (
            boxes.withColumn("_own", _level(cell))
            .withColumn("_at", F.explode(_placements(top, query)))
            .withColumn("_level", F.col("_at.level"))
            .withColumn("_role", F.col("_at.role"))
            .drop("_at", "_own")
        )
        size = F.lit(cell) * F.pow(F.lit(2), F.col("_level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
    return placed.withColumn("_cx", F.explode(span("xMin", "xMax"))).withColumn("_cy", F.explode(span("yMin", "yMax")))


def _placements(top: int, query: bool) -> Column:
    """Where query boxes and searched boxes meet.

    Role ``a``: the query is at its own level, the other box there too or smaller. Role ``b``: the
    other box is at its own level and the query is smaller.
    """
    at = lambda level, role: F.struct(level.cast("int").alias("level"), F.lit(role).alias("role"))
    own, last = F.col("_own"), F.lit(top)
    upward = lambda first, role: F.when(
        first <= last, F.transform(F.sequence(first, last), lambda l: at(l, role))
    ).otherwise(F.array().cast("array<struct<level:int,role:string>>"))
    if query:
        return F.concat(F.array(at(own, "a")), upward(own + 1, "b"))
    larger = F.when(own > 0, F.array(at(own, "b"))).otherwise(F.array().cast("array<struct<level:int,role:string>>"))
    return F.concat(upward(own, "a"), larger)


def box_join(
    queries: DataFrame,
    boxes: DataFrame,
    cell: int | None = None,
    match_same_id: bool = False,
    carry: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
    together: bool = False,
) -> DataFrame:
    """Pairs (``id``, ``hit``) of a query box and a box that intersects it.

    Equality join on grid cells, whose side follows the usual box unless ``cell`` is given. Boxes wider than a cell live on coarser grids, so none covers more
    than 2 x 2 cells; a pair meets on the grid of its larger box and counts only in the cell that
    holds the lower left corner of the intersection. Crowded cells are cut into chunks.

    ``together`` is for :func:`box_hits`, which then needn't shuffle pairs: if no box is wider than a cell, all pairs of a query row are in one
    place, named by further columns, and a query without hits has a row with a NULL hit.
    """
    columns = list(dict.fromkeys([*BOX, *carry]))
    cell, top = _grid(queries, boxes, cell)
    if together and top == 0 and not carry and not match_same_id:
        return _pairs_at_home(queries, boxes, cell, group_rows)
    left = _in_cells(queries.select(*columns), top, True, cell)
    right = _in_cells(boxes.select(*columns), top, False, cell)
    right = right.select(*[F.col(c).alias(f"b_{c}") for c in columns], "_level", "_role", "_cx", "_cy")
    joined = salted_join(left, right, ["_level", "_role", "_cx", "_cy"], "id", "b_id", group_rows)
    size = F.lit(cell) * F.pow(F.lit(2), F.col("_level"))
    corner = (F.floor(F.greatest("xMin", "b_xMin") / size) == F.col("_cx")) & (
        F.floor(F.greatest("yMin", "b_yMin") / size) == F.col("_cy")
    )
    meets = regions_intersect() if match_same_id else boxes_intersect()
    extra = [c for n in carry for c in (F.col(n), F.col(f"b_{n}"))]
    return joined.where(corner & meets).select("id", F.col("b_id").alias("hit"), *extra)


def _pairs_at_home(queries: DataFrame, boxes: DataFrame, cell: int, group_rows: int) -> DataFrame:
    """``id``, ``hit``, the place of the query and ``_several``: each query in the cell of its lower left corner, the boxes it may meet copied there."""
    corner = lambda axis: F.floor(F.col(axis) / F.lit(float(cell)))
    left = _marked(queries.select(*BOX)).withColumn("_cx", corner("xMin")).withColumn("_cy", corner("yMin"))
    wide = queries.agg(F.max(F.col("xMax") - F.col("xMin")), F.max(F.col("yMax") - F.col("yMin"))).first()
    span = lambda lo, hi, reach: F.explode(
        F.sequence(F.floor((F.col(lo) - F.lit(max(reach or 0, 0))) / F.lit(float(cell))), F.floor(F.col(hi) / F.lit(float(cell))))
    )
    right = boxes.select(*[F.col(c).alias(f"b_{c}") for c in BOX])
    right = right.withColumn("_cx", span("b_xMin", "b_xMax", wide[0])).withColumn("_cy", span("b_yMin", "b_yMax", wide[1]))
    count = lambda side, l, r: side.select("_cx", "_cy", F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    sizes = count(left, 1, 0).unionByName(count(right, 0, 1)).groupBy("_cx", "_cy").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    compared = sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    left, right, place = salted_sides(left, right, ["_cx", "_cy"], "id", "b_id", group_rows, cut_right=False)
    if compared > TASK_PAIRS:
        tasks = max(-(-compared // TASK_PAIRS), left.sparkSession.sparkContext.defaultParallelism)
        left, right = left.repartition(tasks, *place), right.repartition(tasks, *place)
    left, right = left.alias("l"), right.alias("r").hint("merge")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in place]
    pairs = left.join(right, [*same, boxes_intersect()], "left")
    return pairs.select("id", F.col("b_id").alias("hit"), *[F.col(f"l.{c}").alias(c) for c in place], "_several")


def _marked(queries: DataFrame) -> DataFrame:
    """Queries with ``_several``: their id is NULL or that of other rows too."""
    several = queries.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1 OR id IS NULL").select("id")
    several = materialize(several, "several")
    if several.isEmpty():
        return queries.withColumn("_several", F.lit(False))
    same = F.col("q.id").eqNullSafe(F.col("s.id"))
    marked = queries.alias("q").join(several.withColumn("_several", F.lit(True)).alias("s"), same, "left")
    return marked.select(*[F.col(f"q.{c}") for c in queries.columns], F.coalesce("_several", F.lit(False)).alias("_several"))


def box_hits(pairs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Sorted hits per query; queries without hits are absent unless ``queries`` is given.

    Pairs that :func:`box_join` left together are collected where they are; only those of repeated ids are shuffled by id.
    """
    collected = F.sort_array(F.collect_list("hit")).alias("hits")
    if "_several" not in pairs.columns:
        hits = pairs.groupBy("id").agg(collected)
        if queries is None:
            return hits
        return queries.select("id").join(hits, "id", "left").withColumn(
            "hits", F.coalesce("hits", F.array().cast("array<bigint>"))
        )
    lists = pairs.where("NOT _several").groupBy(*_HOME, "id").agg(collected).select("id", "hits")
    shared = pairs.where("_several AND hit IS NOT NULL").select("id", "hit")
    if queries is None:
        return lists.where(F.size("hits") > 0).unionByName(box_hits(shared))
    return lists.unionByName(box_hits(shared, _marked(queries.select("id")).where("_several")))


def total_hits(boxes: DataFrame, cell: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number of ordered intersecting pairs; equal boxes are counted once and weighted.

    Boxes with whole coordinates and sides of at most ``COUNT_SIDE`` are counted from their corners, so no pair is formed
    and the work is linear in the boxes. Others are joined.
    """
    distinct = materialize(boxes.groupBy(*AXES).agg(F.count("*").alias("n"), F.min("id").alias("id")), "boxes")
    weighted = lambda pairs: pairs.select((F.col("n") * F.col("b_n")).alias("hits"))
    joined = lambda left, right: weighted(box_join(left, right, cell, carry=["n"], group_rows=group_rows))
    side = _count_side(distinct, cell)
    if side is None:
        between = joined(distinct, distinct)
    else:
        sound = (F.col("xMin") <= F.col("xMax")) & (F.col("yMin") <= F.col("yMax"))
        upright, turned = distinct.where(sound), distinct.where(~sound)
        between = _counted_hits(upright, side, group_rows)
        if not turned.isEmpty():
            between = between.unionByName(joined(turned, distinct)).unionByName(joined(upright, turned))
    among_equal = distinct.select((F.col("n") * (F.col("n") - 1)).alias("hits"))
    return between.unionByName(among_equal).agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("bigint").alias("total_hits"))


def _count_side(boxes: DataFrame, cell: int | None) -> int | None:
    """Side of the cells in which corners are counted: a power of two no box is wider than; None if that does not apply."""
    if not all(dict(boxes.dtypes)[a] in ("tinyint", "smallint", "int", "bigint") for a in AXES):
        return None
    cell, top = _grid(boxes, boxes, cell)
    side = cell << top
    return side if side <= COUNT_SIDE else None


def _counted_hits(distinct: DataFrame, side: int, group_rows: int) -> DataFrame:
    """``hits`` whose sum is the number of pairs between upright boxes of different ids, each pair weighted by ``n`` of both."""
    marked = _marked(distinct.where("id IS NOT NULL"))
    # Pairs of one id do not count; most often these are boxes with themselves.
    alone = marked.where("NOT _several").select((-F.col("n") * F.col("n")).alias("hits"))
    several = marked.where("_several").drop("_several").withColumn("_row", F.xxhash64(*AXES))
    others = several.select(*[F.col(c).alias("id" if c == "id" else f"b_{c}") for c in several.columns])
    own = salted_join(several, others, ["id"], "_row", "b__row", group_rows).where(regions_intersect())
    own = own.select((-F.col("n") * F.col("b_n")).alias("hits"))
    return _in_places(marked, side).mapInArrow(_hits_of_cells(side), "hits bigint").unionByName(alone).unionByName(own)


def _in_places(boxes: DataFrame, side: int) -> DataFrame:
    """Boxes in each cell they cover, in order of the cells, with ``_at``: the places of their sides in the cell.

    Places outside are one place before and one after the cell on each axis.
    """
    placed = _in_cells(boxes, 0, True, side)
    inside = lambda axis, c: F.greatest(F.least(F.col(axis) - F.col(c) * side, F.lit(side)), F.lit(-1)) + 1
    at = F.lit(0)
    for axis in AXES:
        at = at * (side + 2) + inside(axis, "_cx" if axis[0] == "x" else "_cy")
    return placed.select("_cx", "_cy", at.cast("int").alias("_at"), "n").repartition("_cx", "_cy").sortWithinPartitions("_cx", "_cy")


def _hits_of_cells(side: int):
    """A function from boxes in places to the number of ordered pairs, a box with itself included, each in the cell of its intersection's lower left corner.

    Boxes that cover a cell and meet each other also meet in it. Pairs that meet are all pairs less those apart on an axis, plus those apart on
    both. Of these, pairs that both come from the left, or both from below, belong to a cell before.
    """
    places = side + 2

    def below(counts: np.ndarray, axis: int) -> np.ndarray:
        return np.cumsum(counts, axis=axis) - counts

    def apart(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return 2 * (lower * below(upper, 1)).sum(axis=1)

    def hits(counts: np.ndarray) -> int:
        low, high, low_high, high_low = np.moveaxis(counts.reshape(-1, len(_CORNERS), places, places), 1, 0)
        both = (low * below(below(high, 1), 2)).sum(axis=(1, 2))
        above = below(high_low[:, :, ::-1], 2)[:, :, ::-1]
        both = 2 * (both + (low_high * below(above, 1)).sum(axis=(1, 2)))
        met = low.sum(axis=(1, 2)) ** 2 - apart(low.sum(axis=2), high.sum(axis=2)) - apart(low.sum(axis=1), high.sum(axis=1)) + both
        left = low[:, 0, :].sum(axis=1) ** 2 - apart(low[:, 0, :], low_high[:, 0, :])
        under = low[:, :, 0].sum(axis=1) ** 2 - apart(low[:, :, 0], high_low[:, :, 0])
        return int((met - left - under + low[:, 0, 0] ** 2).sum())

    def corners(cell: np.ndarray, cells: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many boxes have a corner at each place of each cell, per kind of corner."""
        place = dict(zip(reversed(AXES), (at // places**i % places for i in range(len(AXES)))))
        kinds = [np.bincount((cell * places + place[x]) * places + place[y], n, cells * places**2) for x, y in _CORNERS]
        return np.stack([kind.reshape(cells, -1) for kind in kinds], axis=1).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, name, held = 0, None, np.zeros((0, len(_CORNERS), places**2), dtype=np.int64)
        for batch in batches:
            x, y, at, n = (batch.column(i).to_numpy() for i in range(4))
            edges = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(x)]])
            for first in range(0, len(edges) - 1 if len(x) else 0, COUNT_CELLS):
                last = min(first + COUNT_CELLS, len(edges) - 1)
                rows = slice(edges[first], edges[last])
                cell = np.repeat(np.arange(last - first), np.diff(edges[first : last + 1]))
                counts = corners(cell, last - first, at[rows].astype(np.int64), n[rows])
                # The last cell may go on in the next rows.
                if name == (x[rows][0], y[rows][0]):
                    counts[0] += held[0]
                else:
                    total += hits(held)
                name, held = (x[rows][-1], y[rows][-1]), counts[-1:].copy()
                total += hits(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([total + hits(held)], pa.int64())], names=["hits"])

    return count


def kd_partition(boxes: DataFrame, cutoff: int, group_rows: int = 200_000) -> DataFrame:
    """Add ``leaf_id``: the median split path of the box, with at most ``cutoff`` boxes per leaf.

    Axes take turns (xMin, yMin, xMax, yMax); boxes up to the lower median of (coordinate, id) go
    low. Cell sizes follow from the total, so no level has to count. While there are fewer cells than
    shuffle partitions, or cells are larger than ``group_rows``, each level of a table above ``group_rows`` reads one written copy and
    counts boxes per coordinate, so no box is shuffled; a smaller table, or one with equal boxes of one id on both sides of a median, is numbered in a distributed way, and that copy
    goes once the next one is written. Below that, cells are spread over tasks and all remaining levels are
    local sorts without a shuffle.
    """
    total = boxes.count()
    depth = 0
    while -(-total // (1 << depth)) > cutoff:
        depth += 1
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = total > group_rows and depth > 0
    if counted:
        boxes = materialize(boxes, "boxes")
    state = boxes.withColumn("leaf_id", F.lit(1).cast("bigint")).withColumn("_n", F.lit(total).cast("bigint"))
    columns = boxes.columns
    low = F.floor((F.col("_n") + 1) / 2).cast("bigint")

    def descend(cells: DataFrame, high: Column) -> DataFrame:
        split = F.col("_n") > cutoff
        bit = F.when(high, 1).otherwise(0)
        return cells.select(
            *columns,
            *[c for c in cells.columns if c == "_group"],
            F.when(split, F.col("leaf_id") * 2 + bit).otherwise(F.col("leaf_id")).alias("leaf_id"),
            F.when(~split, F.col("_n")).when(high, F.col("_n") - low).otherwise(low).alias("_n"),
        )

    level, ranked = 0, None
    while level < depth and ((1 << level) < tasks or -(-total // (1 << level)) > group_rows):
        axis = AXES[level % 4]
        medians = _medians(state.where(F.col("_n") > cutoff), axis, low) if counted else None
        if medians is not None:
            state = descend(state.join(F.broadcast(medians), "leaf_id", "left"), F.struct(axis, "id") > F.col("_median"))
        else:
            counted = False
            above, ranked = ranked, number_rows(state, [axis, "id"], ["leaf_id"], seq="_rank", total="_size")
            if above is not None:
                release(above)
            state = descend(ranked, F.col("_rank") > low)
        level += 1
    if level < depth:
        state = state.withColumn("_group", F.col("leaf_id")).repartition("_group")
        while level < depth:
            cell = Window.partitionBy("_group", "leaf_id").orderBy(AXES[level % 4], "id")
            state = descend(state.withColumn("_rank", F.row_number().over(cell)), F.col("_rank") > low)
            level += 1
    return state.select(*columns, "leaf_id")


def _medians(cells: DataFrame, axis: str, low: Column) -> DataFrame | None:
    """``leaf_id`` and ``_median``: (coordinate, id) of the last box of each cell that goes low; None if an equal one would go high.

    Boxes are counted per cell and coordinate; only those on the median coordinate are put in order of their ids.
    """
    counts = materialize(cells.groupBy("leaf_id", "_n", axis).agg(F.count("*").alias("_m")), "counts")
    if counts.count() <= BROADCAST_ROWS:
        totals = counts.withColumn("_upto", F.sum("_m").over(Window.partitionBy("leaf_id").orderBy(axis)))
    else:
        totals = running_total(counts, "_m", [axis], ["leaf_id"], "_upto")
    before = F.col("_upto") - F.col("_m")
    here = totals.where((before < low) & (F.col("_upto") >= low))
    here = materialize(here.select("leaf_id", F.col(axis).alias("_value"), (low - before).alias("_k"), "_m"), "coordinates")
    on = cells.join(F.broadcast(here), "leaf_id").where(F.col(axis).eqNullSafe(F.col("_value"))).select("leaf_id", "_value", "id", "_k")
    if (here.agg(F.sum("_m")).first()[0] or 0) <= BROADCAST_ROWS:
        ranked = on.withColumn("_rank", F.row_number().over(Window.partitionBy("leaf_id").orderBy("id")))
    else:
        ranked = number_rows(on, ["id"], ["leaf_id"], seq="_rank", total="_size")
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.struct(F.col("_value").alias(axis), "id")))
    medians = ranked.where(F.col("_rank").between(F.col("_k"), F.col("_k") + 1))
    medians = materialize(medians.groupBy("leaf_id").agg(at(F.col("_k")).alias("_median"), at(F.col("_k") + 1).alias("_next")), "medians")
    release(counts)
    return medians.select("leaf_id", "_median") if medians.where("_median <=> _next").isEmpty() else None


def leaf_regions(partitioned: DataFrame) -> DataFrame:
    """Bounding region and size of each leaf."""
    return partitioned.groupBy("leaf_id").agg(
        F.min("xMin").alias("xMin"), F.min("yMin").alias("yMin"),
        F.max("xMax").alias("xMax"), F.max("yMax").alias("yMax"), F.count("*").alias("boxes"),
    )


def box_join_regions(
    queries: DataFrame, boxes: DataFrame, cutoff: int = 128, cell: int | None = None, group_rows: int = 200_000
) -> DataFrame:
    """Pairs (``id``, ``hit``) by way of leaf regions.

    A query visits the leaves whose region it intersects. Leaves hold at most ``cutoff`` boxes
    however the boxes are spread. The regions grow in number with the data, so they are matched by
    :func:`box_join` and not broadcast. A leaf with very many visits is cut into chunks of them.
    """
    leaves = materialize(kd_partition(boxes.select(*BOX), cutoff, group_rows), "leaves")
    regions = leaf_regions(leaves).withColumnRenamed("leaf_id", "id")
    visits = box_join(queries.select(*BOX), regions, cell, match_same_id=True, carry=list(AXES))
    visits = materialize(visits.select("id", F.col("hit").alias("leaf_id"), *AXES), "visits")
    members = leaves.select(*[F.col(c).alias(f"b_{c}") for c in BOX], "leaf_id")
    met = salted_join(visits, members, ["leaf_id"], "id", "b_id")
    return met.where(boxes_intersect()).select("id", F.col("b_id").alias("hit"))


def region_hits(
    queries: DataFrame, boxes: DataFrame, cutoff: int = 128, cell: int | None = None, group_rows: int = 200_000, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """Sorted hits per query by way of leaf regions, as :func:`box_hits` of :func:`box_join_regions`, without a shuffle of pairs.

    Queries whose lower left corners are close form a block. A block visits the leaves whose region meets its own and gets the boxes of these
    that meet its region, so a query finds all its hits in one place. What is shuffled grows with the boxes; only lists of repeated ids are merged.
    """
    leaves = materialize(kd_partition(boxes.select(*BOX), cutoff, group_rows), "leaves")
    regions = leaf_regions(leaves).withColumnRenamed("leaf_id", "id")
    side = _block_side(queries, cell, block_queries)
    corner = lambda axis: F.floor(F.col(axis) / F.lit(float(side)))
    asked = _marked(queries.select(*BOX).na.drop()).withColumn("_cx", corner("xMin")).withColumn("_cy", corner("yMin"))
    bounds = asked.groupBy("_cx", "_cy").agg(*[(F.min if a.endswith("Min") else F.max)(a).alias(a) for a in AXES])
    blocks = materialize(bounds.withColumn("id", F.monotonically_increasing_id()), "blocks")
    visits = box_join(blocks.select(*BOX), regions, match_same_id=True, carry=list(AXES))
    visits = materialize(visits.select(F.col("id").alias("_block"), F.col("hit").alias("leaf_id"), *AXES), "visits")
    members = leaves.where("id IS NOT NULL").select(*[F.col(c).alias(f"b_{c}") for c in BOX], "leaf_id")
    held = members.join(visits, "leaf_id").where(regions_intersect()).select("_block", *[f"b_{c}" for c in BOX])
    placed = asked.join(blocks.select("_cx", "_cy", F.col("id").alias("_block")), ["_cx", "_cy"]).drop("_cx", "_cy")
    # The work is in the pairs: partitions must not be joined because their bytes are few.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def collect(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"id": [], "hits": []})
        held = held.sort_values("b_id")
        low_x, low_y, high_x, high_y, ids = (held[f"b_{c}"].to_numpy() for c in [*AXES, "id"])
        found, rows = [], min(TILE_QUERIES, max(1, BLOCK_PAIRS // len(held)))
        asked = asked.sort_values("xMin")
        for start in range(0, len(asked), rows):
            q = {c: asked[c].to_numpy()[start : start + rows, None] for c in BOX}
            # Queries of a tile are close on one axis: most boxes of the block are out of reach of all of them.
            some = np.flatnonzero((low_x <= q["xMax"].max()) & (high_x >= q["xMin"].min()))
            near = (q["xMax"] >= low_x[some]) & (q["xMin"] <= high_x[some]) & (q["yMax"] >= low_y[some]) & (q["yMin"] <= high_y[some])
            row, column = np.nonzero(near & (q["id"] != ids[some]))
            found += np.split(ids[some[column]], np.searchsorted(row, np.arange(1, len(near))))
        lists = pd.DataFrame({"id": asked["id"].to_numpy(), "hits": pd.Series(found, dtype=object)})
        return lists[np.array([len(x) > 0 for x in found])]

    types = [dict(df.dtypes)["id"] for df in (queries, boxes)]

    def lists(part: DataFrame) -> DataFrame:
        left, right, place = salted_sides(part.drop("_several"), held, ["_block"], "id", "b_id", block_queries, cut_right=False)
        groups = [df.repartition(tasks, *place).groupBy(*place) for df in (left, right)]
        return groups[0].cogroup(groups[1]).applyInPandas(collect, f"id {types[0]}, hits array<{types[1]}>")

    several = placed.where("_several")
    if several.isEmpty():
        return lists(placed)
    merged = lists(several).groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    return lists(placed.where("NOT _several")).unionByName(merged)


def _block_side(queries: DataFrame, cell: int | None, block_queries: int) -> int:
    """Side of the cells whose queries are a block: as many as it may have if they were spread evenly, at least a usual cell and at most 32."""
    cell, _ = _grid(queries, queries, cell)
    size = extent(queries).first()
    if not size["boxes"]:
        return cell
    even = sqrt(max(1.0, float(size["xExtent"] or 1)) * max(1.0, float(size["yExtent"] or 1)) * block_queries / 2 / size["boxes"])
    return min(cell * 32, max(cell, 1 << ceil(log2(max(1.0, even)))))
