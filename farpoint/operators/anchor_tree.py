"""Range joins by two levels of anchors: a few that every task holds, and below them a table that grows with the data."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.operators.pivots import _SLACK, Anchors, _with_home, close_pairs
from farpoint.operators.skew import GROUP_ROWS, salted_sides
from farpoint.session import materialize, release

# Rows measured against a chunk of leaf anchors at a time.
SLICE = 512
# Pairs of a product of a leaf's visitors and its points, and pairs found that are held at a time, or from one leaf.
PRODUCT, HELD_PAIRS, LEAF_PAIRS = 1 << 18, 1 << 20, 1 << 23
# Points of a bundle of leaves at most: a task holds two bundles. And points that are measured against the leaves of one at a time.
BUNDLE_ROWS, ASKED = 10 * GROUP_ROWS, 4096


def _measured(rows: pd.DataFrame, leaves: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the rows with their distances to all leaf anchors."""
    anchors = np.stack(leaves["_anchor"].to_numpy()).astype("float64")
    squares = (anchors * anchors).sum(axis=1)
    for start in range(0, len(rows), SLICE):
        part = slice(start, start + SLICE)
        points = np.stack(rows["_v"].iloc[part].to_numpy()).astype("float64")
        rough = (points * points).sum(axis=1)[:, None] + squares[None, :] - 2.0 * (points @ anchors.T)
        yield part, np.sqrt(np.maximum(rough, 0.0))


def _rounding(dimension: int, *lengths: float) -> float:
    """How far sums and differences of distances from products may be off for vectors of at most these lengths."""
    return 4.0 * float(np.sqrt(np.finfo("float64").eps * (dimension + 4) * sum(x * x for x in lengths)))


def _longest(vectors: pd.Series) -> tuple[int, float]:
    """Dimension and largest length."""
    rows = np.stack(vectors.to_numpy()).astype("float64")
    return rows.shape[1], float(np.sqrt((rows * rows).sum(axis=1).max()))


def _leaf_anchors(placed: DataFrame, tops: Anchors) -> DataFrame:
    """``_cell``, ``_leaf`` and ``_anchor``: in every cell its own anchor, and about the square root of its rows of other points.

    Points are chosen by a hash of their vector, so copies give one anchor.
    """
    sizes = placed.groupBy("_cell").agg(F.ceil(F.sqrt(F.count("*"))).alias("_every"))
    drawn = placed.join(F.broadcast(sizes), "_cell").where(F.pmod(F.xxhash64("_v"), F.col("_every")) == 0)
    drawn = drawn.select("_cell", F.col("_v").cast("array<double>").alias("_anchor")).distinct()
    given = [(cell, vector) for cell, vector in enumerate(tops.vectors)]
    own = placed.sparkSession.createDataFrame(given, "_cell int, _anchor array<double>").join(F.broadcast(sizes.select("_cell")), "_cell")
    return materialize(drawn.union(own).withColumn("_leaf", F.monotonically_increasing_id()), "leaves")


def anchor_tree(points: DataFrame, pivots: DataFrame, id_column: str, vector: str, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Points placed at their anchors of both levels, and the leaf anchors.

    Points: ``_row`` (a number per row), ``_id``, ``_v``, ``_dists`` to the upper anchors, ``_cell``, ``_leaf`` and ``_d``, the distance
    to the leaf anchor, the nearest in its cell. Leaves: ``_cell``, ``_leaf``, ``_anchor``, ``_cover`` (largest ``_d``; leaves without
    points are left out). The number of leaves grows with the square root of a cell's rows and isn't limited; only the upper
    anchors are held by every task. Points without a usable vector have no place.
    """
    tops = Anchors.read(pivots, id_column, vector)
    rows = points.select(F.col(id_column).alias("_id"), F.col(vector).alias("_v"))
    homed = _with_home(rows, tops, "_v").where("_home IS NOT NULL")
    homed = homed.select("_id", "_v", "_dists", F.col("_home.cell").alias("_cell"), F.monotonically_increasing_id().alias("_row"))
    placed = materialize(homed, "placed")
    leaves = _leaf_anchors(placed, tops)
    # A cell's leaves are few, about the square root of its rows: all are held beside each chunk of points, which go on with their vectors.
    left, right, keys = salted_sides(placed, leaves, ["_cell"], "_row", "_leaf", group_rows, cut_right=False)
    place = ["_row", "_id", "_v", "_dists", "_cell"]

    def nearest(points: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        if points.empty or leaves.empty:
            return pd.DataFrame({c: [] for c in [*place, "_d", "_leaf"]})
        leaves, found = leaves.sort_values("_leaf"), []
        for part, away in _measured(points, leaves):
            best = away.argmin(axis=1)
            least = away[np.arange(len(best)), best]
            found.append(points[place].iloc[part].assign(_d=least, _leaf=leaves["_leaf"].to_numpy()[best]))
        return pd.concat(found)

    schema = ", ".join(f"{c} {t}" for c, t in placed.select(*place).dtypes) + ", _d double, _leaf bigint"
    members = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, schema), "members")
    covers = members.groupBy("_leaf").agg(F.max("_d").alias("_cover"))
    covered = materialize(leaves.join(covers, "_leaf"), "covered")
    release(placed)
    release(leaves)
    return members, covered


def _in_bundles(members: DataFrame, leaves: DataFrame, bundle_rows: int, sizes: dict[int, int]) -> DataFrame:
    """Leaves with ``_part``: consecutive leaves that hold about ``bundle_rows`` points together.

    A leaf with more points is there several times, with ``_sub`` from 0: its points are dealt to as many chunks. ``sizes`` are the points by cell.
    """
    cells = range(max(sizes, default=0) + 1)
    before_cell = F.array(*[F.lit(sum(n for cell, n in sizes.items() if cell < c)).cast("bigint") for c in cells])
    # With an id of its points a leaf can stand among them without a NULL, which would turn ids into doubles.
    counts = members.groupBy("_leaf").agg(F.count("*").alias("_n"), F.min("_id").alias("_id")).withColumn("_chunks", F.ceil(F.col("_n") / bundle_rows).cast("int"))
    each = leaves.join(counts, "_leaf").withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    share = F.col("_n") / F.col("_chunks")
    before = F.sum(share).over(Window.partitionBy("_cell").orderBy("_leaf", "_sub")) - share + F.get(before_cell, F.col("_cell"))
    part = F.floor(F.round(before, 3) / bundle_rows).cast("int").alias("_part")
    return materialize(each.select("_cell", part, "_leaf", "_sub", "_chunks", "_id", "_anchor", "_cover"), "bundles")


def _reached(away: np.ndarray, cover: np.ndarray, cells: np.ndarray, reach: float, slack: float) -> np.ndarray:
    """Which leaves points search, by their distances: leaves whose cover they reach and that aren't too far behind the nearest of their cell.

    The leaves come in order of their cells.
    """
    starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    least = np.repeat(np.minimum.reduceat(away, starts, axis=1), np.diff(np.append(starts, len(cells))), axis=1)
    return (away <= cover + reach + slack) & (away <= least + 2 * reach + slack)


def anchor_tree_join(
    points: DataFrame,
    pivots: DataFrame,
    id_column: str,
    vector: str,
    radius: float,
    include_self: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """All pairs within ``radius``, found through two levels of anchors: id, ``nb_`` id and ``distance``.

    By the triangle inequality a point searches an upper cell only if the cell's cover reaches it and its anchor is at
    most twice the radius farther than the point's own, and in it a leaf on the same two conditions. Leaves are
    bundled: a point is sent once for each bundle it reaches, to where this bundle meets the point's own. Points of a pair reach each other's
    bundles, so they meet there, and only there. In that place a point is compared with the leaves it reaches, and distances to the leaf anchor rule out
    pairs before the exact test. Bundles are few and large, as every point may reach all of them in many dimensions; crowded
    leaves are cut into chunks. Repeated rows are points of their own, but rows of one id pair only with
    ``include_self``. Points without a usable vector are in no pair. An empty table gives an empty table.
    """
    reach = radius + _SLACK * (1.0 + radius)
    spark = points.sparkSession
    if not include_self:
        # A row without an id differs from none.
        points = points.where(F.col(id_column).isNotNull())
    members, leaves = anchor_tree(points, pivots, id_column, vector, group_rows)
    # One row per upper anchor at most.
    cells = members.groupBy("_cell").agg(F.max(F.get("_dists", F.col("_cell"))).alias("cover"), F.count("*").alias("n")).collect()
    rows = sum(c.n for c in cells)
    bundle_rows = group_rows
    if group_rows == GROUP_ROWS:
        # Large bundles are sent to few others; still there should be two pairs of them for each core.
        bundle_rows = min(BUNDLE_ROWS, max(GROUP_ROWS, ceil(rows / ceil(sqrt(4 * spark.sparkContext.defaultParallelism)))))
    bundles = _in_bundles(members, leaves, bundle_rows, {c["_cell"]: c.n for c in cells})
    own = bundles.select("_leaf", "_sub", "_chunks", F.col("_part").alias("_own"))
    cell_cover = np.full(max((c["_cell"] for c in cells), default=0) + 1, -np.inf)
    for c in cells:
        cell_cover[c["_cell"]] = c.cover
    chunks = max(1, ceil(rows / max(group_rows, GROUP_ROWS)))
    dealt = members.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int"))
    beside = bundles.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kept = ["_row", "_id", "_v", "_leaf", "_d"]

    def reachable(points: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: [] for c in [*kept, "_parts"]})]
        if len(points) and len(leaves):
            leaves = leaves.sort_values(["_cell", "_leaf", "_sub"])
            cover, at, parts = (leaves[c].to_numpy() for c in ("_cover", "_cell", "_part"))
            dimension, length = _longest(points["_v"])
            slack = _rounding(dimension, length, _longest(leaves["_anchor"])[1] + float(cover.max()))
            names, number = np.unique(parts, return_inverse=True)
            for part, away in _measured(points, leaves):
                dists = np.stack(points["_dists"].iloc[part].to_numpy())
                near = (dists <= np.append(cell_cover, np.full(dists.shape[1] - len(cell_cover), -np.inf)) + reach) & (dists <= dists.min(axis=1, keepdims=True) + 2 * reach)
                i, j = np.nonzero(_reached(away, cover, at, reach, slack) & near[:, at])
                reached = np.zeros((len(away), len(names)), dtype=bool)
                reached[i, number[j]] = True
                found.append(points[kept].iloc[part].assign(_parts=[names[r] for r in reached]))
        return pd.concat(found[1:] or found)

    types = dict(members.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", _parts array<int>"
    visits = materialize(dealt.groupBy("_salt").cogroup(beside.groupBy("_salt")).applyInPandas(reachable, schema), "visits")
    release(members)
    chunk = F.pmod(F.xxhash64("_row"), F.col("_chunks")).cast("int")
    homed = visits.join(own, "_leaf").where(chunk == F.col("_sub"))
    # A point is in its own bundle whatever rounding says of its leaf.
    homed = homed.withColumn("_part", F.explode(F.array_union("_parts", F.array("_own"))))
    pair = [F.least("_own", "_part").alias("_lo"), F.greatest("_own", "_part").alias("_hi")]
    met = homed.select(*pair, "_id", "_v", "_own", "_leaf", "_d", F.lit(None).cast("array<double>").alias("_anchor"), F.lit(None).cast("double").alias("_cover"), F.lit(None).cast("int").alias("_cell"))
    lower = bundles.dropDuplicates(["_part", "_leaf"]).withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_part"))))
    asked = lower.select("_lo", F.col("_part").alias("_hi"), "_id", F.lit(None).cast(types["_v"]).alias("_v"), F.col("_part").alias("_own"), "_leaf", F.lit(None).cast("double").alias("_d"), "_anchor", "_cover", "_cell")
    # The work is in the pairs: partitions must not be joined because their bytes are few, and pairs of bundles should be alone in one.
    most = bundles.agg(F.max("_part")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (most + 1) * (most + 2))
    id_type = points.schema[id_column].dataType.simpleString()
    nb_id = f"nb_{id_column}"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = pd.concat(list(batches))
        alike = met["_lo"].iloc[0] == met["_hi"].iloc[0]
        is_leaf = met["_anchor"].notna()
        leaves, met = met[is_leaf].sort_values(["_cell", "_leaf"]), met[~is_leaf]
        a, b = (met[met["_own"] == met[side]] for side in ("_lo", "_hi"))
        if a.empty or b.empty:
            return
        b = b.sort_values("_leaf")
        y = np.stack(b["_v"].to_numpy()).astype("float64")
        dimension, length = _longest(a["_v"])
        slack = _rounding(dimension, length, _longest(b["_v"])[1] + float(b["_d"].max()))
        leaf_slack = _rounding(dimension, length, _longest(leaves["_anchor"])[1] + float(leaves["_cover"].max()))
        ids, others, d = a["_id"].to_numpy(), b["_id"].to_numpy(), b["_d"].to_numpy()
        cover, at, names = (leaves[c].to_numpy() for c in ("_cover", "_cell", "_leaf"))
        low, high = (np.searchsorted(b["_leaf"].to_numpy(), names, side) for side in ("left", "right"))
        found, held = [], 0
        for start in range(0, len(a), ASKED):
            some = a.iloc[start : start + ASKED]
            x = np.stack(some["_v"].to_numpy()).astype("float64")
            away = np.concatenate([distances for _, distances in _measured(some, leaves)])
            reached = _reached(away, cover, at, reach, leaf_slack)
            for leaf in np.flatnonzero((high > low) & reached.any(axis=0)):
                visitors, part = np.flatnonzero(reached[:, leaf]), slice(low[leaf], high[leaf])
                size = int(high[leaf] - low[leaf])
                for first in range(0, len(visitors), max(1, LEAF_PAIRS // size)):
                    now = visitors[first : first + max(1, LEAF_PAIRS // size)]
                    i, j, distance = close_pairs(x[now], y[part], away[now, leaf], d[part], radius, rows=max(SLICE, PRODUCT // size), ring_slack=slack)
                    if not len(i):
                        continue
                    one, two = ids[start + now[i]], others[part][j]
                    found.append(pd.DataFrame({id_column: one, nb_id: two, "distance": distance}))
                    if not alike:
                        found.append(pd.DataFrame({id_column: two, nb_id: one, "distance": distance}))
                    held += len(i)
                    if held >= HELD_PAIRS:
                        yield pd.concat(found)
                        found, held = [], 0
        if found:
            yield pd.concat(found)

    schema = f"`{id_column}` {id_type}, `{nb_id}` {id_type}, distance double"
    pairs = met.unionByName(asked).repartition(tasks, "_lo", "_hi").groupBy("_lo", "_hi").applyInPandas(compare, schema)
    return pairs if include_self else pairs.where(F.col(id_column) != F.col(nb_id))
