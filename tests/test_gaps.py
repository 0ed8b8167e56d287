"""Rows with NULL keys and NULL or NaN values stay in every result."""

import math

import pytest
from pyspark.sql import functions as F

from farpoint import Attr, OutlierParams, WindowSpec
from farpoint.operators import pivots
from farpoint.operators.cells import cell_outliers, cluster_neighbors, micro_clusters
from farpoint.operators.evidence import window_status
from farpoint.operators.numbering import number_rows
from farpoint.operators.ranges import neighbor_counts
from farpoint.operators.skew import hot_keys, salted_join

NAN = float("nan")
ROWS = [(i, None if i in (2, 5) else "u", v) for i, v in enumerate([1.0, 1.1, None, 1.2, NAN, 1.3, 1.4, 1.5])]


def test_null_keys_are_numbered(spark):
    df = spark.createDataFrame(ROWS, "id int, user string, value double")
    got = {(r.id, r.user, r.seq, r.stream_rows) for r in number_rows(df, ["id"], ["user"]).collect()}
    users = {u: [i for i, v, _ in ROWS if v == u] for u in ("u", None)}
    assert got == {(i, u, n, len(ids)) for u, ids in users.items() for n, i in enumerate(ids, 1)}


def test_points_without_a_value_are_outliers(spark):
    df = number_rows(spark.createDataFrame(ROWS, "id int, user string, value double"), ["id"])
    spec, attrs, params = WindowSpec(8, 4), [Attr("value")], OutlierParams(radius=0.5, k=2)
    full = window_status(df, spec, attrs, params, identity=["id"], method="pairs").where("status = 'Outlier'")
    short = cell_outliers(df, spec, attrs, params, identity=["id"])
    assert {r.id for r in short.collect()} == {r.id for r in full.collect()} == {2, 4}


# id, value, kind; kinds a and b, or none.
GAPS = [(i, v, k) for i, (v, k) in enumerate(
    [(1.0, "a"), (1.1, None), (None, "a"), (1.2, "b"), (NAN, "a"), (1.3, None), (1.0, "a"), (NAN, None), (float("inf"), "b"), (1.2, "b")]
)]
ATTRS = [Attr("value"), Attr("kind", "nominal")]


def _near(a, b, radius):
    if any(v is None or not math.isfinite(v) for v in (a[1], b[1])):
        return False
    return math.sqrt((a[1] - b[1]) ** 2 + (a[2] is None or a[2] != b[2])) <= radius


@pytest.mark.parametrize("radius", [0.15, 0.5, 1.005, 1.5])
def test_every_row_is_counted_by_both_methods(spark, radius):
    df = number_rows(spark.createDataFrame(GAPS, "id int, value double, kind string"), ["id"])
    slide, width = 2, 6
    expected = {
        (w, a[0], sum(_near(a, b, radius) and b[0] // slide >= a[0] // slide for b in window if b is not a),
         sum(_near(a, b, radius) and b[0] // slide < a[0] // slide for b in window))
        for w in range(2, 5)
        for window in [GAPS[(w - 2) * slide : (w + 1) * slide]]
        for a in window
    }
    for method in ("pairs", "ordered"):
        got = window_status(df, WindowSpec(width, slide), ATTRS, OutlierParams(radius, 2), identity=["id"], method=method)
        rows = [(r.window_id, r.id, r.succ, r.prev) for r in got.collect()]
        assert len(rows) == len(expected) and set(rows) == expected, method


@pytest.mark.parametrize("radius", [0.15, 1.005])
@pytest.mark.parametrize("cap", [None, 1])
@pytest.mark.parametrize("numbers", [1, 2])
def test_neighbor_counts_keep_every_row(spark, radius, cap, numbers):
    df = spark.createDataFrame([(*r, 0.0) for r in GAPS], "id int, value double, kind string, other double")
    attrs = ATTRS if numbers == 1 else [*ATTRS, Attr("other")]
    got = {r.id: r.neighbors for r in neighbor_counts(df, attrs, radius, cap).collect()}
    counts = {a[0]: sum(_near(a, b, radius) for b in GAPS if b is not a) for a in GAPS}
    assert got == {i: n if cap is None else min(n, cap) for i, n in counts.items()}


def test_null_keys_keep_their_windows(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "u", float(i)) for i in range(8)], "id int, user string, value double")
    points = number_rows(df, ["id"], ["user"])
    for method in ("pairs", "ordered"):
        got = window_status(points, WindowSpec(4, 2), [Attr("value")], OutlierParams(2.5, 1), ["user"], ["id"], method=method)
        assert sorted(r.id for r in got.collect()) == list(range(8)), method


def test_many_tied_hot_keys_are_all_split(spark):
    left = spark.range(600).select(F.col("id").alias("a"), (F.col("id") % 200).alias("k"))
    right = spark.range(600).select(F.col("id").alias("b"), (F.col("id") % 200).alias("k"))
    assert hot_keys(left, right, ["k"], 2).count() == 200
    joined = salted_join(left, right, ["k"], "a", "b", 2)
    assert "TakeOrdered" not in joined._jdf.queryExecution().executedPlan().toString()
    rows = [(r.a, r.b) for r in joined.collect()]
    assert len(rows) == len(set(rows)) == 1800 and all(a % 200 == b % 200 for a, b in rows)


# Key, value, kind: NULL keys, values that are missing, not finite or beyond all cells, and columns with names that are used inside.
ODD = [
    (u, i, v, k, "n", 1, "s", 0.5)
    for i, (u, v, k) in enumerate(
        (u, v, k)
        for u in (None, 1)
        for v, k in [(1.0, "a"), (1.1, "a"), (1.2, "a"), (1.3, None), (None, "a"), (NAN, "a"), (float("inf"), "a"), (float("inf"), "a"),
                     (-float("inf"), "a"), (1e300, "a"), (1e300, "a"), (2e300, "a"), (4e300, "a"), (0.0, "a"), (9.0, "b"), (0.1, "a")]
    )
]
ODD_SCHEMA = "u int, at int, v double, k string, n string, ds int, status string, distance double"
ODD_ATTRS = [Attr("v"), Attr("k", "nominal")]


def test_cells_lose_no_outlier(spark):
    df = number_rows(spark.createDataFrame(ODD, ODD_SCHEMA), ["at"], ["u"])
    spec, params = WindowSpec(8, 4), OutlierParams(0.5, 2)
    full = window_status(df, spec, ODD_ATTRS, params, ["u"], ["n"], method="pairs").where("status = 'Outlier'").collect()
    short = cell_outliers(df, spec, ODD_ATTRS, params, ["u"], ["n"]).collect()
    assert sorted(map(tuple, short), key=str) == sorted(map(tuple, full), key=str) and {r.u for r in short} == {None, 1}


def test_clusters_hold_real_places_only_and_keep_null_keys(spark):
    df = number_rows(spark.createDataFrame(ODD, ODD_SCHEMA), ["at"], ["u"])
    clusters = micro_clusters(df, WindowSpec(8, 4), ODD_ATTRS, 0.5, ["u"]).collect()
    assert all(r.v is not None and abs(r.v) < 10 and r.k is not None for r in clusters)
    assert sum(r.n for r in clusters) == 12
    near = cluster_neighbors(df, WindowSpec(16, 4), ODD_ATTRS, 0.8, ["u"]).collect()
    by_key = {u: {tuple(r)[1:] for r in near if r.u == u} for u in (None, 1)}
    assert by_key[None] == by_key[1] and by_key[1]


def test_vectors_that_are_missing_or_not_finite(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [0.1, 0.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [5.0, 0.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id int, p array<double>")
    anchors = df.where("id IN (1, 6)")
    got = {r.id: (r.pivot_id, r.distance) for r in pivots.assign_pivots(df, anchors, "id", "p").collect()}
    assert got == {1: (1, 0.0), 3: (1, 0.1), 6: (6, 0.0), **{i: (None, None) for i in (2, 4, 5, 7)}}
    assert {(r.id, r.nb_id) for r in pivots.pivot_range_join(df, anchors, "id", "p", 0.2).collect()} == {(1, 3), (3, 1)}
    assert {r.id: r.side for r in pivots.split_between(df, [0.0, 0.0], [5.0, 0.0], "id", "p").collect()} == {1: 1, 3: 1, 6: 2, 2: None, 4: None, 5: None, 7: None}


def test_numbering_refuses_columns_of_its_own_names(spark):
    with pytest.raises(ValueError, match="seq"):
        number_rows(spark.createDataFrame([(1, 2)], "id int, seq int"), ["id"])
