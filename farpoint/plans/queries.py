"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.functions.boxes import boxes_intersect, less_than, more_than
from farpoint.functions.distance import mixed_distance, rounded, vector_distance, within
from farpoint.functions.status import expiry, total_of_map
from farpoint.operators import boxes as bx
from farpoint.operators import anchor_tree as tree
from farpoint.operators import cells, clean, evidence, neighbors, numbering, pivots, ranges, windows
from farpoint.operators.sweep import sweep
from farpoint.plans import tables as t
from farpoint.plans.boxes import search_job
from farpoint.plans.sensor import sensor_outliers
from farpoint.session import scratch_dir
from farpoint.sources import boxes as box_source
from farpoint.sources import points as point_source
from farpoint.sources import sensor
from farpoint.specs import Attr, OutlierParams, WindowSpec, attr_roles, identity_columns
from farpoint.streaming.changes import rocksdb_state, stream_status_changes as status_changes
from farpoint.streaming.keyed import stream_outliers_keyed
from farpoint.streaming.windows import StreamJob

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPEC, PARAMS, ATTRS = t.EVENT_SPEC, t.EVENT_PARAMS, t.EVENT_ATTRS
ARRIVAL_WIDTH = 200
SWEEP = {"widths": [100, 200, 300], "slide": 50, "radii": [1.005, 2.005, 3.005], "ks": [3, 5, 8]}
ORDERS_RADIUS, LINE_RADIUS, SELF_RADIUS, VECTOR_RADIUS = 75.005, 1.05, 0.055, 1.15
LEAF_CUTOFF = 100


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _out(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Windows and outliers ------------------------------------------------------------------------


@query
def number_rows(spark, sf):
    return t.numbered_events(spark, sf).select("event_id", "seq", "stream_rows")


@query
def number_rows_keyed(spark, sf):
    return t.user_events(spark, sf).select("user_id", "event_id", "seq", "stream_rows")


@query
def sliding_windows(spark, sf):
    return windows.sliding_windows(t.numbered_events(spark, sf), SPEC).select("window_id", "slide_id", "seq", "event_id")


@query
def window_bounds(spark, sf):
    return windows.window_bounds(t.numbered_events(spark, sf), SPEC)


@query
def slide_sizes(spark, sf):
    return windows.slide_sizes(t.numbered_events(spark, sf), SPEC)


@query
def window_status(spark, sf):
    return evidence.window_status(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS, identity=["event_id"])


@query
def window_status_wide(spark, sf):
    return evidence.window_status(t.numbered_events(spark, sf), WindowSpec(1000, 500), ATTRS, PARAMS, identity=["event_id"])


@query
def window_status_ordered(spark, sf):
    points = t.numbered_events(spark, sf)
    return evidence.window_status(points, WindowSpec(1000, 500), ATTRS, PARAMS, identity=["event_id"], method="ordered")


@query
def window_status_keyed(spark, sf):
    points = t.user_events(spark, sf)
    return evidence.window_status(points, t.USER_SPEC, ATTRS, t.USER_PARAMS, ["user_id"], ["event_id"])


@query
def window_report(spark, sf):
    roles = attr_roles(
        [("event_id", "nominal", "Int"), ("user_id", "nominal", "Int"), ("event_type", "nominal", "String"), ("value", "numeric", "Double")],
        used=["value", "event_type"],
        not_used=["event_id", "user_id"],
    )
    points = t.numbered_events(spark, sf, "user_id")
    return evidence.window_report(points, SPEC, roles, PARAMS, identity=identity_columns(roles))


@query
def window_outliers(spark, sf):
    points = t.numbered_events(spark, sf)
    return evidence.window_report(points, SPEC, ATTRS, PARAMS, identity=["event_id"], only_outliers=True)


@query
def outlier_counts(spark, sf):
    return evidence.outlier_counts(evidence.window_status(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS))


@query
def window_pairs(spark, sf):
    pairs = neighbors.window_pairs(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS.radius)
    return pairs.withColumn("distance", F.round("distance", 6))


@query
def window_evidence(spark, sf):
    return evidence.window_evidence(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS.radius)


@query
def evidence_map(spark, sf):
    counts = evidence.window_evidence(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS.radius)
    earlier = counts.where("nb_slide < slide_id").groupBy("seq")
    prev = F.map_from_entries(F.collect_list(F.struct("nb_slide", "n")))
    return earlier.agg(prev.alias("prev")).select("seq", total_of_map("prev").alias("prev_total"))


@query
def minimal_evidence(spark, sf):
    return evidence.minimal_evidence(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS)


@query
def trigger_slide(spark, sf):
    return evidence.trigger_slide(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS)


@query
def due_checks(spark, sf):
    points = t.numbered_events(spark, sf)
    triggers = evidence.trigger_slide(points, SPEC, ATTRS, PARAMS)
    gone = F.col("window_id") - SPEC.panes
    expired = windows.window_bounds(points, SPEC).where(gone >= 0).select(gone.alias("slide_id"))
    return evidence.due_checks(triggers, expired)


@query
def preceding_neighbors(spark, sf):
    lists = evidence.preceding_neighbors(t.numbered_events(spark, sf), ARRIVAL_WIDTH, ATTRS, PARAMS.radius)
    return lists.select("seq", F.array_join("pre_neighbors", ",").alias("pre_neighbors"))


@query
def next_check(spark, sf):
    return evidence.next_check(t.numbered_events(spark, sf), ARRIVAL_WIDTH, ATTRS, PARAMS)


@query
def check_schedule(spark, sf):
    return evidence.check_schedule(t.numbered_events(spark, sf), ARRIVAL_WIDTH, ATTRS, PARAMS)


@query
def status_timeline(spark, sf):
    return evidence.status_timeline(t.numbered_events(spark, sf), ARRIVAL_WIDTH, ATTRS, PARAMS)


@query
def cell_outliers(spark, sf):
    points = t.numbered_events(spark, sf)
    found = cells.cell_outliers(points, SPEC, ATTRS, PARAMS, identity=["event_id"])
    return found.select("window_id", "seq", "event_id", "status")


@query
def cell_outliers_wide(spark, sf):
    points = t.numbered_events(spark, sf)
    found = cells.cell_outliers(points, WindowSpec(1000, 500), ATTRS, PARAMS, identity=["event_id"])
    return found.select("window_id", "seq", "event_id", "status")


@query
def micro_clusters(spark, sf):
    clusters = cells.micro_clusters(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS.radius)
    return clusters.select("slide_id", "cluster_id", "event_type", "value", "n", F.round("radius", 6).alias("radius"))


@query
def cluster_neighbors(spark, sf):
    found = cells.cluster_neighbors(t.numbered_events(spark, sf), SPEC, ATTRS, PARAMS.radius)
    return found.withColumn("distance", F.round("distance", 6))


@query
def parameter_sweep(spark, sf):
    return sweep(t.numbered_events(spark, sf), attrs=ATTRS, **SWEEP)


@query
def live_points(spark, sf):
    points = t.numbered_events(spark, sf)
    last = points.agg(F.max("seq")).scalar()
    live = neighbors.live_points(points, last, ARRIVAL_WIDTH)
    return live.select("seq", "event_id", expiry("seq", ARRIVAL_WIDTH).alias("exp_seq"))


@query
def remove_points(spark, sf):
    rows = t.events(spark, sf)
    return neighbors.remove_points(rows, rows.where("event_type = 'error'"), ["event_id"]).select("event_id", "value")


# Distances and range joins -------------------------------------------------------------------


@query
def mixed_distances(spark, sf):
    points = t.numbered_events(spark, sf).select("seq", "value", "event_type")
    before = points.select((F.col("seq") + 1).alias("seq"), F.col("value").alias("b_value"), F.col("event_type").alias("b_event_type"))
    distance = mixed_distance(ATTRS)
    return points.join(before, "seq").select(
        "seq",
        F.round(distance, 6).alias("distance"),
        F.round(mixed_distance(ATTRS, squared=True), 6).alias("squared"),
        within(distance, PARAMS.radius).alias("near"),
    )


@query
def vector_distances(spark, sf):
    rows = t.vectors(spark, sf).select("vec_id", "embedding")
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b_embedding"))
    return rows.join(before, "vec_id").select("vec_id", F.round(vector_distance("embedding", "b_embedding"), 5).alias("distance"))


@query
def range_join_mixed(spark, sf):
    points = t.order_points(spark, sf)
    pairs = ranges.range_join(points, points, "o_orderkey", t.ORDER_ATTRS, ORDERS_RADIUS, binned=2)
    return pairs.withColumn("distance", rounded("distance"))


@query
def range_join_self(spark, sf):
    points = t.events(spark, sf)
    pairs = ranges.range_join(points, points, "event_id", ATTRS, SELF_RADIUS, include_self=True)
    return pairs.withColumn("distance", rounded("distance"))


@query
def range_join_vec(spark, sf):
    dims = [Attr(f"v{i}") for i in range(64)]
    unpacked = t.vectors(spark, sf).select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(64)])
    pairs = ranges.range_join(unpacked, unpacked, "vec_id", dims, VECTOR_RADIUS)
    return pairs.withColumn("distance", rounded("distance"))


@query
def neighbor_counts(spark, sf):
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[a.name for a in t.LINE_ATTRS])
    counts = ranges.neighbor_counts(lines, t.LINE_ATTRS, LINE_RADIUS)
    return counts.select("l_orderkey", "l_linenumber", "neighbors")


@query
def neighbor_counts_capped(spark, sf):
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[a.name for a in t.LINE_ATTRS])
    counts = ranges.neighbor_counts(lines, t.LINE_ATTRS, LINE_RADIUS, cap=6)
    return counts.select("l_orderkey", "l_linenumber", "neighbors")


@query
def neighbor_counts_ordered(spark, sf):
    return ranges.neighbor_counts(t.events(spark, sf), ATTRS, PARAMS.radius).select("event_id", "neighbors")


@query
def pivot_range_join(spark, sf):
    anchors = t.label_anchors(spark, sf)
    pairs = pivots.pivot_range_join(t.vectors(spark, sf), anchors, "vec_id", "embedding", VECTOR_RADIUS)
    return pairs.withColumn("distance", rounded("distance"))


@query
def anchor_tree_join(spark, sf):
    anchors = t.label_anchors(spark, sf)
    pairs = tree.anchor_tree_join(t.vectors(spark, sf), anchors, "vec_id", "embedding", VECTOR_RADIUS)
    return pairs.withColumn("distance", rounded("distance"))


@query
def assign_pivots(spark, sf):
    found = pivots.assign_pivots(t.vectors(spark, sf), t.label_anchors(spark, sf), "vec_id", "embedding")
    return found.withColumn("distance", F.round("distance", 6))


@query
def assign_covering_pivots(spark, sf):
    anchors = t.label_anchors(spark, sf).withColumn("radius", F.lit(1.2) + F.col("label") * 0.01)
    found = pivots.assign_pivots(t.vectors(spark, sf), anchors, "vec_id", "embedding", radius="radius")
    return found.withColumn("distance", F.round("distance", 6))


@query
def pivot_radius(spark, sf):
    found = pivots.assign_pivots(t.vectors(spark, sf), t.label_anchors(spark, sf), "vec_id", "embedding")
    return pivots.pivot_radius(found).withColumn("radius", F.round("radius", 6))


@query
def split_between_anchors(spark, sf):
    rows = t.label_anchors(spark, sf).orderBy("label").limit(2).collect()
    sides = pivots.split_between(t.vectors(spark, sf), rows[0]["embedding"], rows[1]["embedding"], "vec_id", "embedding")
    return sides.withColumn("distance", F.round("distance", 6))


@query
def farthest_first_pivots(spark, sf):
    chosen = pivots.pick_pivots(t.vectors(spark, sf), "vec_id", "embedding", 8)
    return chosen.select("vec_id")


# Sensor preparation --------------------------------------------------------------------------

READING_BOUNDS = {"value": (1, 300)}
READING_MEANS = {"value": "value"}


def _bucketed(spark: SparkSession, sf: str, quantity: int, unit: str) -> DataFrame:
    rows = clean.plausible(t.readings(spark, sf), READING_BOUNDS)
    return clean.bucket_means(rows, quantity, unit, READING_MEANS).withColumn("value", F.round("value", 6))


@query
def bucket_means_second(spark, sf):
    return _bucketed(spark, sf, 30, "second")


@query
def bucket_means_minute(spark, sf):
    return _bucketed(spark, sf, 10, "minute")


@query
def bucket_means_hour(spark, sf):
    return _bucketed(spark, sf, 6, "hour")


@query
def bucket_means_day(spark, sf):
    return _bucketed(spark, sf, 1, "day")


@query
def hourly_means(spark, sf):
    means = clean.hourly_means(t.readings(spark, sf), {"value": "avg_value"}, ["user_id"])
    return means.withColumn("avg_value", F.round("avg_value", 6))


@query
def plausible_rows(spark, sf):
    return clean.plausible(t.events(spark, sf), READING_BOUNDS).select("event_id", "value")


@query
def first_difference(spark, sf):
    rows = t.events(spark, sf).select("user_id", "ts", "event_id", "value", F.col("value").alias("magnitude"))
    changes = clean.first_difference(rows, t.EVENT_ORDER, ["value"], ["magnitude"], ["user_id"])
    return changes.select("user_id", "event_id", F.round("value", 4).alias("value"), F.round("magnitude", 4).alias("magnitude"))


@query
def sensor_chain(spark, sf):
    found = sensor_outliers(
        t.readings(spark, sf), 6, "hour", t.USER_SPEC, t.USER_PARAMS, ["user_id"], [Attr("value")],
        READING_BOUNDS, READING_MEANS, signed=["value"], absolute=[],
    )
    return found.select("user_id", "window_id", "seq", "day", "hour", "succ", "prev", "status")


@query
def csv_round_trip(spark, sf):
    path = _out(spark, "means")
    means = clean.bucket_means(t.readings(spark, sf), 1, "hour", READING_MEANS, ["user_id"])
    sensor.write_csv(means, path)
    return sensor.read_sensor_csv(spark, path, means.schema).withColumn("value", F.round("value", 6))


@query
def sorted_parquet_round_trip(spark, sf):
    path = _out(spark, "sorted")
    order = ["year", "month", "day", "hour"]
    means = clean.bucket_means(t.readings(spark, sf), 1, "hour", READING_MEANS)
    sensor.write_sorted(means, path, order)
    return spark.read.parquet(path).withColumn("value", F.round("value", 6))


@query
def delimited_cells(spark, sf):
    path = _out(spark, "cells")
    t.events(spark, sf).select(F.concat_ws(",", "event_id", "event_type", "user_id").alias("value")).write.text(path)
    lines = sensor.read_delimited(spark, path)
    return lines.select(F.col("cells")[0].cast("bigint").alias("event_id"), F.col("cells")[1].alias("event_type"), F.size("cells").alias("n"))


@query
def parsed_points(spark, sf):
    path = _out(spark, "points")
    rows = t.events(spark, sf).select("event_id", "user_id", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    rows.write.option("header", True).csv(path)
    points, rejected = point_source.to_points(point_source.read_points(spark, path), ["event_id", "user_id", "value"])
    rejected_ids = rejected.select(F.col("event_id").cast("double").alias("event_id"), F.lit(None).cast("double").alias("value"))
    return points.select("event_id", "value").unionByName(rejected_ids)


# Ordered tables ------------------------------------------------------------------------------


def _priced_orders(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


PRICE_ORDER = ["o_totalprice", "o_orderkey"]


@query
def split_at(spark, sf):
    return numbering.split_at(_priced_orders(spark, sf), PRICE_ORDER, 5000)


@query
def first_row(spark, sf):
    return numbering.first_row(_priced_orders(spark, sf), PRICE_ORDER)


@query
def last_row(spark, sf):
    return numbering.last_row(_priced_orders(spark, sf), PRICE_ORDER)


@query
def drop_first(spark, sf):
    return numbering.drop_first(_priced_orders(spark, sf), PRICE_ORDER)


@query
def partition_rows(spark, sf):
    return numbering.partition_sizes(t.table(spark, sf, "lineitem")).agg(F.sum("rows").alias("rows"))


# Boxes ---------------------------------------------------------------------------------------


@query
def box_pairs(spark, sf):
    boxes = t.order_boxes(spark, sf)
    return bx.box_join(boxes, boxes)


@query
def box_hits(spark, sf):
    boxes = t.order_boxes(spark, sf)
    return bx.box_hits(bx.box_join(boxes, boxes, together=True)).select("id", F.array_join("hits", ",").alias("hits"))


@query
def box_hits_with_empty(spark, sf):
    boxes = t.order_boxes(spark, sf)
    hits = bx.box_hits(bx.box_join(boxes, boxes, together=True), boxes)
    return hits.select("id", F.array_join("hits", ",").alias("hits"))


@query
def total_hits(spark, sf):
    return bx.total_hits(t.order_boxes(spark, sf))


@query
def extent(spark, sf):
    return bx.extent(t.order_boxes(spark, sf))


@query
def tile_boxes(spark, sf):
    return bx.tile_boxes(t.order_boxes(spark, sf), 3)


@query
def tiled_total_hits(spark, sf):
    return bx.total_hits(bx.tile_boxes(t.order_boxes(spark, sf), 3))


@query
def box_join_regions(spark, sf):
    boxes = t.order_boxes(spark, sf)
    return bx.box_join_regions(boxes, boxes, LEAF_CUTOFF)


@query
def kd_partition(spark, sf):
    return bx.kd_partition(t.order_boxes(spark, sf), LEAF_CUTOFF).select("id", "leaf_id")


@query
def leaf_regions(spark, sf):
    return bx.leaf_regions(bx.kd_partition(t.order_boxes(spark, sf), LEAF_CUTOFF))


@query
def rejected_boxes(spark, sf):
    turned = t.order_boxes(spark, sf).withColumn("yMax", F.col("yMax") - F.col("id") % 5 - 1)
    return bx.validate_boxes(turned, on_error="only")


@query
def box_order(spark, sf):
    first = bx.BOX
    top = t.order_boxes(spark, sf).select(*first)
    pivot = numbering.first_row(top, ["yMax", "id"]).select(*[F.col(c).alias(f"b_{c}") for c in first])
    row = F.struct(*[f"b_{c}" for c in first]).alias("b")
    marked = top.withColumn("b", pivot.select(row).scalar()).select(*first, "b.*")
    return marked.select(
        "id",
        less_than("xMin").alias("x_less"),
        more_than("yMax").alias("y_more"),
        boxes_intersect().alias("meets"),
    )


@query
def super_keys(spark, sf):
    top = t.order_boxes(spark, sf).select(*bx.BOX)
    pivot = numbering.first_row(top, ["yMax", "id"]).select(F.struct(*[F.col(c).alias(f"b_{c}") for c in bx.BOX]).alias("b"))
    marked = top.withColumn("b", pivot.scalar()).select(*bx.BOX, "b.*")
    less = [less_than(a).alias(f"{a}_less") for a in bx.AXES]
    return marked.select("id", *less, *[more_than(a).alias(f"{a}_more") for a in bx.AXES])


def _box_file(spark: SparkSession, sf: str) -> str:
    """Boxes as text, one line each in order of id."""
    path = _out(spark, "boxes")
    ordered = t.order_boxes(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    ordered.select(F.concat_ws("\t", *bx.AXES).alias("value")).write.text(path)
    return path


@query
def box_file_ids(spark, sf):
    return box_source.read_boxes(spark, _box_file(spark, sf))


@query
def box_job(spark, sf):
    found = search_job(spark, _box_file(spark, sf), LEAF_CUTOFF)
    return found.select("id", F.array_join("hits", ",").alias("hits"))


@query
def boxes_from_file(spark, sf):
    path = _out(spark, "boxes")
    lines = t.order_boxes(spark, sf).select(F.concat_ws("\t", "xMin", "yMin", "xMax", "yMax").alias("value"))
    lines.write.text(path)
    return bx.extent(box_source.read_boxes(spark, path))


# Streams -------------------------------------------------------------------------------------

STREAM_BATCHES = 3


def _run_on_growing_folder(spark: SparkSession, sf: str, start: Callable) -> None:
    """Run a stream over the events each time the next part of them, in order of time, has arrived."""
    folder = _out(spark, "stream")
    rows = t.events(spark, sf)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = rows.select(at.alias("at")).approxQuantile("at", [i / STREAM_BATCHES for i in range(1, STREAM_BATCHES)], 0.01)
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows
        if low is not None:
            part = part.where(at > int(low))
        if high is not None:
            part = part.where(at <= int(high))
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


@query
def stream_window_status(spark, sf):
    job = StreamJob(SPEC, PARAMS, ATTRS, t.EVENT_ORDER, _out(spark, "windows"), identity=["event_id"])
    _run_on_growing_folder(spark, sf, job.start)
    return job.read(spark).select("window_id", "seq", "event_id", "succ", "prev", "status")


@query
def stream_window_status_keyed(spark, sf):
    job = StreamJob(t.USER_SPEC, t.USER_PARAMS, ATTRS, t.EVENT_ORDER, _out(spark, "windows"), ["user_id"], ["event_id"])
    _run_on_growing_folder(spark, sf, job.start)
    return job.read(spark).select("user_id", "window_id", "seq", "event_id", "succ", "prev", "status")


@query
def stream_outliers_by_key(spark, sf):
    folder = _out(spark, "keyed")

    def start(stream: DataFrame):
        status = stream_outliers_keyed(stream, "user_id", t.EVENT_ORDER, ATTRS, t.USER_SPEC, t.USER_PARAMS, ["event_id"])
        writer = status.writeStream.format("parquet").option("path", f"{folder}/out")
        return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    _run_on_growing_folder(spark, sf, start)
    return spark.read.parquet(f"{folder}/out")


@query
def stream_status_changes(spark, sf):
    folder = _out(spark, "changes")

    def start(stream: DataFrame):
        changes = status_changes(stream, "user_id", t.EVENT_ORDER, ATTRS, t.USER_SPEC.width, t.USER_PARAMS)
        writer = changes.writeStream.format("parquet").option("path", f"{folder}/out")
        with rocksdb_state(spark):
            return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    _run_on_growing_folder(spark, sf, start)
    return spark.read.parquet(f"{folder}/out")
