import random

import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farpoint import Attr, OutlierParams, WindowSpec
from farpoint.operators import cells, evidence, neighbors
from farpoint.operators.numbering import number_rows
from farpoint.operators.sweep import sweep
from farpoint.operators.windows import slide_sizes, sliding_windows, window_bounds

V = [Attr("v")]
VT = [Attr("v"), Attr("t", "nominal", "String")]
VXT = [Attr("v"), Attr("x"), Attr("t", "nominal", "String")]


def numbered(spark, points, **columns):
    rows = [(i + 1, len(points), *p.values()) for i, p in enumerate(points)]
    types = {"v": "double", "x": "double", "t": "string", "u": "int"}
    schema = "seq bigint, stream_rows bigint" + "".join(f", {c} {types[c]}" for c in points[0])
    return spark.createDataFrame(rows, schema)


def as_dict(status):
    return {(r.window_id, r.seq): (r.succ, r.prev, r.status) for r in status.collect()}


def random_points(n, seed, spread=12):
    r = random.Random(seed)
    return [{"v": r.randint(0, spread) / 2, "x": r.randint(0, 6) / 2, "t": r.choice("ab")} for _ in range(n)]


def test_statuses_by_hand(spark):
    # Slides of two: (0, 0.5) near each other; 5 alone at first; 10 far; 6 exactly 1 from 5; tail partial.
    points = [{"v": v} for v in (0.0, 0.5, 5.0, 10.0, 6.0, 20.0, 30.0, 40.0, 50.0)]
    got = as_dict(evidence.window_status(numbered(spark, points), WindowSpec(4, 2), V, OutlierParams(1.0, 1)))
    assert got[1, 1] == got[1, 2] == (1, 0, "Safe")
    assert got[1, 3] == (0, 0, "Outlier") and got[2, 3] == (1, 0, "Safe")  # the neighbour arrived
    assert got[2, 5] == (0, 1, "Unsafe") and got[3, 5] == (0, 0, "Outlier")  # and expired
    assert got[1, 4] == got[2, 4] == (0, 0, "Outlier")
    assert max(w for w, _ in got) == 3 and (3, 9) not in got
    assert got == brute.window_status(points, 4, 2, 1.0, 1, ["v"])


def test_nominal_difference_counts_one(spark):
    points = [{"v": 1.0, "t": "a"}, {"v": 1.0, "t": "b"}]
    for radius, status in ((0.99, "Outlier"), (1.0, "Safe")):
        got = evidence.window_status(numbered(spark, points), WindowSpec(2, 2), VT, OutlierParams(radius, 1))
        assert {r.status for r in got.collect()} == {status}


@pytest.mark.parametrize("method", ["pairs", "ordered"])
@pytest.mark.parametrize("width,slide,radius", [(20, 5, 1.5), (24, 24, 0.5), (6, 1, 1.0), (17, 4, 2.25)])
def test_window_status_equals_brute_force(spark, method, width, slide, radius):
    points = [{"v": p["v"], "t": p["t"]} for p in random_points(83, width)]
    got = evidence.window_status(
        numbered(spark, points), WindowSpec(width, slide), VT, OutlierParams(radius, 4), method=method
    )
    assert as_dict(got) == brute.window_status(points, width, slide, radius, 4, ["v"], ["t"])


def test_many_attributes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MIN_BLOCK", 4)
    monkeypatch.setattr(neighbors, "MAX_BLOCK", 7)
    points = random_points(97, 5)
    got = evidence.window_status(numbered(spark, points), WindowSpec(30, 10), VXT, OutlierParams(1.5, 5))
    assert as_dict(got) == brute.window_status(points, 30, 10, 1.5, 5, ["v", "x"], ["t"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.tuples(st.integers(-8, 8), st.sampled_from("abc")), min_size=1, max_size=40),
    shape=st.sampled_from([(4, 2), (9, 3), (5, 1)]),
    radius=st.sampled_from([0.0, 0.5, 1.0, 1.5, 3.0]),
)
def test_both_methods_equal_brute_force(spark, values, shape, radius):
    points = [{"v": v / 2, "t": t} for v, t in values]
    expected = brute.window_status(points, *shape, radius, 2, ["v"], ["t"])
    for method in ("pairs", "ordered"):
        got = evidence.window_status(
            numbered(spark, points), WindowSpec(*shape), VT, OutlierParams(radius, 2), method=method
        )
        assert as_dict(got) == expected


def test_keys_are_independent_and_one_may_dominate(spark):
    r = random.Random(3)
    users = {0: 90, 1: 20, 2: 7}
    rows = [(u, i, r.randint(0, 20) / 2, r.choice("ab")) for u, n in users.items() for i in range(n)]
    r.shuffle(rows)
    df = number_rows(spark.createDataFrame(rows, "u int, at int, v double, t string").repartition(5), ["at"], ["u"])
    got = evidence.window_status(df, WindowSpec(10, 5), VT, OutlierParams(1.0, 2), ["u"], ["at"]).collect()
    for u in users:
        points = [{"v": v, "t": t} for uu, _, v, t in sorted(rows) if uu == u]
        mine = {(x.window_id, x.seq): (x.succ, x.prev, x.status) for x in got if x.u == u}
        assert mine == brute.window_status(points, 10, 5, 1.0, 2, ["v"], ["t"])
        assert all(x.at == x.seq - 1 for x in got if x.u == u)


def test_shift_and_thresholds(spark):
    points = random_points(60, 9)
    shifted = [p | {"v": p["v"] + 64.0} for p in points]
    spec = WindowSpec(20, 5)
    run = lambda pts, r, k: as_dict(evidence.window_status(numbered(spark, pts), spec, VXT, OutlierParams(r, k)))
    out = lambda result: {key for key, (_, _, s) in result.items() if s == "Outlier"}
    base = run(points, 1.0, 3)
    assert run(shifted, 1.0, 3) == base
    assert out(run(points, 1.5, 3)) <= out(base) <= out(run(points, 1.0, 5))


def test_report_outliers_counts_and_metrics(spark):
    points = random_points(40, 1)
    df = numbered(spark, points)
    args = (df, WindowSpec(20, 5), VXT, OutlierParams(1.0, 2))
    report = evidence.window_report(*args, identity=["t"]).collect()
    assert all(r.n_neighbors == r.succ + r.prev and r.to_seq - r.from_seq == 19 for r in report)
    only = evidence.window_report(*args, only_outliers=True).collect()
    assert len(only) == sum(r.status == "Outlier" for r in report)
    status = evidence.window_status(*args)
    counts = {r.window_id: r for r in evidence.outlier_counts(status).collect()}
    assert sum(r.outliers for r in counts.values()) == len(only) and all(r.points == 20 for r in counts.values())
    from pyspark.sql import Observation

    seen = Observation("run")
    evidence.observed(status, seen).collect()
    assert seen.get == {"rows": len(report), "outliers": len(only)}


def test_evidence_walk_and_triggers(spark):
    points = [{"v": p["v"]} for p in random_points(80, 4)]
    width, slide, k, radius = 20, 5, 4, 0.5
    df, spec, params = numbered(spark, points), WindowSpec(width, slide), OutlierParams(radius, k)
    status = brute.window_status(points, width, slide, radius, k, ["v"])
    expected, triggers = set(), set()
    for (w, seq), (succ, _, state) in status.items():
        found = succ
        slides = []
        for s in range((seq - 1) // slide - 1, w - spec.panes, -1):
            if found >= k:
                break
            n = sum(abs(points[seq - 1]["v"] - points[j]["v"]) <= radius for j in range(s * slide, (s + 1) * slide))
            if n:
                found += n
                slides.append((w, seq, s, n, found, state))
        expected |= set(slides)
        if state == "Unsafe":
            triggers.add((w, seq, slides[-1][2]))
    assert {tuple(r) for r in evidence.minimal_evidence(df, spec, V, params).collect()} == expected
    found = evidence.trigger_slide(df, spec, V, params)
    assert {tuple(r) for r in found.collect()} == triggers
    expired = spark.createDataFrame([(3,), (7,)], "slide_id bigint")
    due = {tuple(r) for r in evidence.due_checks(found, expired).collect()}
    assert due == {(s, seq) for _, seq, s in triggers if s in (3, 7)}


def test_status_timeline_and_next_check(spark):
    points = [{"v": p["v"], "t": p["t"]} for p in random_points(60, 8)]
    df, params = numbered(spark, points), OutlierParams(1.0, 3)
    got = {tuple(r) for r in evidence.status_timeline(df, 15, VT, params).collect()}
    assert got == brute.timeline(points, 15, 1.0, 3, ["v"], ["t"])
    for r in evidence.next_check(df, 15, VT, params).collect():
        near = [j + 1 for j in range(max(0, r.seq - 15), r.seq - 1) if brute.distance(points[r.seq - 1], points[j], ["v"], ["t"]) <= 1.0]
        assert (r.n_prev, r.check_seq) == (len(near), sorted(near)[-3] + 15)


def test_cell_shortcut_finds_the_same_outliers(spark):
    r = random.Random(11)
    points = [{"v": r.choice([1.0, 1.1, 1.2, r.random() * 30]), "x": r.choice([2.0, 2.1, 9.5]), "t": "a"} for _ in range(120)]
    df, spec, params = numbered(spark, points), WindowSpec(40, 10), OutlierParams(1.0, 3)
    got = {(o.window_id, o.seq) for o in cells.cell_outliers(df, spec, VXT, params).collect()}
    exact = brute.window_status(points, 40, 10, 1.0, 3, ["v", "x"], ["t"])
    assert got == {key for key, value in exact.items() if value[2] == "Outlier"} and got


def test_clusters_hold_neighbours_only(spark):
    points = random_points(50, 13)
    df, spec = numbered(spark, points), WindowSpec(20, 10)
    clusters = cells.micro_clusters(df, spec, VXT, 1.0).collect()
    assert sum(c.n for c in clusters) == 50 and all(c.radius <= 1.0 for c in clusters)
    near = {(c.cluster_id, c.nb_cluster) for c in cells.cluster_neighbors(df, spec, VXT, 1.0).collect()}
    by_id = {c.cluster_id: c for c in clusters}
    for a in clusters:
        for b in clusters:
            gap = brute.distance(a, b, ["v", "x"], ["t"])
            linked = a.cluster_id != b.cluster_id and abs(a.slide_id - b.slide_id) < 2 and gap <= 1.0 + a.radius + b.radius
            assert ((a.cluster_id, b.cluster_id) in near) == linked
    assert len(by_id) == len(clusters)


def test_sweep_equals_single_runs(spark):
    points = random_points(70, 17)
    df = numbered(spark, points)
    got = {(r.width, r.radius, r.k, r.window_id): (r.points, r.safe, r.unsafe, r.outliers)
           for r in sweep(df, [10, 25], 5, VXT, [0.5, 1.5], [2, 4]).collect()}
    expected = {}
    for width in (10, 25):
        for radius in (0.5, 1.5):
            for k in (2, 4):
                for (w, _), (_, _, s) in brute.window_status(points, width, 5, radius, k, ["v", "x"], ["t"]).items():
                    c = expected.setdefault((width, radius, k, w), [0, 0, 0, 0])
                    c[0] += 1
                    c[["Safe", "Unsafe", "Outlier"].index(s) + 1] += 1
    assert got == {key: tuple(value) for key, value in expected.items()}


def test_windows_and_slides(spark):
    df = numbered(spark, random_points(23, 2))
    spec = WindowSpec(10, 5)
    assert [tuple(r) for r in window_bounds(df, spec).orderBy("window_id").collect()] == [(1, 1, 10, 10), (2, 6, 15, 10), (3, 11, 20, 10)]
    assert {r.slide_id: r.points for r in slide_sizes(df, spec).collect()} == {0: 5, 1: 5, 2: 5, 3: 5, 4: 3}
    assert sliding_windows(df, spec).count() == 30


def test_points_without_neighbours_or_with_missing_values_stay(spark):
    points = [{"v": None}, {"v": 1.0}, {"v": 1.0}, {"v": None}]
    got = evidence.window_status(numbered(spark, points), WindowSpec(4, 4), V, OutlierParams(1.0, 1))
    assert {r.seq: r.status for r in got.collect()} == {1: "Outlier", 2: "Safe", 3: "Safe", 4: "Outlier"}


def test_neighbour_join_needs_two_shuffles_and_no_nested_loop(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        status = evidence.window_status(
            spark.range(1, 1001).select(F.col("id").alias("seq"), F.lit(1000).cast("bigint").alias("stream_rows"), F.rand(1).alias("v")),
            WindowSpec(100, 50), V, OutlierParams(0.1, 3),
        )
        status.collect()
        plan = status._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert final.count("Exchange hashpartitioning") == 2
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_of_the_neighbour_search_grow_with_the_points(spark, monkeypatch):
    points = numbered(spark, [{"v": float(i % 7)} for i in range(600)])
    few = neighbors.block_pairs(points, WindowSpec(40, 20), V, 1.0).df
    rows = sorted(tuple(r) for r in few.collect())
    monkeypatch.setattr("farpoint.operators.neighbors.TASK_POINTS", 20, raising=False)
    many = neighbors.block_pairs(points, WindowSpec(40, 20), V, 1.0).df
    assert many.rdd.getNumPartitions() >= 30 and sorted(tuple(r) for r in many.collect()) == rows
