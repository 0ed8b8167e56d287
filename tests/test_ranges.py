import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint import Attr
from farpoint.functions.distance import mixed_distance, rounded, vector_distance
from farpoint.operators import numbering, pivots, ranges

ATTRS = [Attr("v"), Attr("x"), Attr("t", "nominal", "String")]


def rows_with_hot_bin(n, seed):
    """A third of the rows in one bin, some of them copies."""
    r = random.Random(seed)
    return [
        {"id": i, "v": 3.0 if i % 6 == 0 else 3.25 if i % 6 == 3 else r.randint(0, 40) / 2, "x": r.randint(0, 8) / 2, "t": r.choice("ab")}
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_with_hot_bin(120, 1)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id bigint, v double, x double, t string").repartition(3)
    return rows, df.cache()


@pytest.mark.parametrize("radius,binned,group_rows", [(0.75, 1, 10_000), (1.0, 2, 10_000), (1.5, 1, 7)])
def test_range_join(table, radius, binned, group_rows):
    rows, df = table
    got = ranges.range_join(df, df, "id", ATTRS, radius, binned=binned, group_rows=group_rows).collect()
    pairs = [(r.id, r.nb_id) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute.close_pairs(rows, "id", radius, ["v", "x"], ["t"])
    with_self = ranges.range_join(df, df, "id", ATTRS, radius, include_self=True, group_rows=group_rows).count()
    assert with_self == len(pairs) + len(rows)


@pytest.mark.parametrize("group_rows", [10_000, 5])
def test_neighbor_counts(table, group_rows):
    rows, df = table
    expected = {a["id"]: sum(brute.distance(a, b, ["v", "x"], ["t"]) <= 1.0 for b in rows) - 1 for a in rows}
    got = {r.id: r.neighbors for r in ranges.neighbor_counts(df, ATTRS, 1.0, group_rows=group_rows).collect()}
    assert got == expected
    capped = {r.id: r.neighbors for r in ranges.neighbor_counts(df, ATTRS, 1.0, cap=4, group_rows=group_rows).collect()}
    assert capped == {i: min(n, 4) for i, n in expected.items()}


@pytest.mark.parametrize("radius", [0.0, 0.5, 1.0, 1.5])
def test_ordered_counts_with_two_nominal_attributes(spark, radius):
    r = random.Random(5)
    rows = [{"id": i, "v": r.randint(0, 20) / 4, "t": r.choice("ab"), "u": r.choice("cd")} for i in range(90)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "id bigint, v double, t string, u string")
    attrs = [Attr("v"), Attr("t", "nominal", "String"), Attr("u", "nominal", "String")]
    got = {x.id: x.neighbors for x in ranges.neighbor_counts(df, attrs, radius).collect()}
    assert got == {a["id"]: sum(brute.distance(a, b, ["v"], ["t", "u"]) <= radius for b in rows) - 1 for a in rows}


def test_distances(spark):
    df = spark.createDataFrame([(1.0, 2, "a", 4.0, 2, "b", [0.0, 3.0], [4.0, 0.0])], "v double, x int, t string, b_v double, b_x int, b_t string, p array<double>, q array<double>")
    row = df.select(
        mixed_distance(ATTRS).alias("d"), mixed_distance(ATTRS, squared=True).alias("s"),
        vector_distance("p", "q").alias("f"), vector_distance("p", "q", 2).alias("w"),
    ).first()
    assert (row.d, row.s, row.f, row.w) == (10.0**0.5, 10.0, 5.0, 5.0)


def test_pivot_range_join(spark):
    rng = np.random.default_rng(3)
    points = np.round(np.concatenate([rng.normal(0, 0.3, (50, 3)), rng.normal(2, 1, (70, 3))]), 2)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, p array<double>").repartition(3)
    anchors = pivots.pick_pivots(df, "id", "p", 5)
    assert anchors.count() == 5
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    expected = {(i, j) for i, j in zip(*np.nonzero(gaps <= 0.7)) if i != j}
    for group_rows in (10_000, 9):
        got = [(r.id, r.nb_id) for r in pivots.pivot_range_join(df, anchors, "id", "p", 0.7, group_rows=group_rows).collect()]
        assert len(got) == len(expected) and set(got) == expected
    ids = [r.id for r in anchors.orderBy("id").collect()]
    for r in pivots.assign_pivots(df, anchors, "id", "p").collect():
        assert r.pivot_id == min(ids, key=lambda a: (gaps[r.id, a], a))
    with pytest.raises(ValueError):
        pivots.Anchors.read(spark.range(300).select("id", F.array(F.lit(1.0)).alias("p")), "id", "p")


def test_tie_between_two_anchors_goes_to_the_second(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [2.0])], "id bigint, p array<double>")
    got = {r.id: r.side for r in pivots.split_between(df, [0.0], [2.0], "id", "p").collect()}
    assert got == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("broadcast_rows", [100_000, 3])
def test_numbering_with_a_dominant_key(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(numbering, "BROADCAST_ROWS", broadcast_rows)
    rows = [(0 if i % 3 else i, (i * 37) % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, at int, i int").repartition(7)
    got = numbering.number_rows(df, ["at"], ["k"]).collect()
    for k in {r[0] for r in rows}:
        mine = sorted((r.seq, r.at, r.stream_rows) for r in got if r.k == k)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1] for m in mine] == sorted(m[1] for m in mine) and {m[2] for m in mine} == {len(mine)}
    whole = numbering.number_rows(df, ["at"]).orderBy("seq").collect()
    assert [r.at for r in whole] == list(range(101)) and [r.seq for r in whole] == list(range(1, 102))
    totals = numbering.running_total(df.withColumn("w", F.lit(2)), "w", ["at"], ["k"], "upto").collect()
    assert {(r.k, r.at, r.upto) for r in totals} == {(r.k, r.at, 2 * r.seq) for r in got}


def test_split_first_last_and_drop(spark):
    df = spark.range(10).select((F.col("id") * 7 % 10).alias("x")).repartition(3)
    parts = lambda k: {p: sorted(r.x for r in rows) for p, rows in _by_part(numbering.split_at(df, ["x"], k)).items()}
    assert parts(4) == {"left": [0, 1, 2], "kth": [3], "right": [4, 5, 6, 7, 8, 9]}
    assert parts(1) == {"kth": [0], "right": list(range(1, 10))}
    assert parts(0) == {"right": list(range(10))} and parts(11) == {"left": list(range(10))}
    assert numbering.first_row(df, ["x"]).first().x == 0 and numbering.last_row(df, ["x"]).first().x == 9
    assert sorted(r.x for r in numbering.drop_first(df, ["x"]).collect()) == list(range(1, 10))
    assert sum(r.rows for r in numbering.partition_sizes(df).collect()) == 10


def _by_part(df):
    parts = {}
    for r in df.collect():
        parts.setdefault(r.part, []).append(r)
    return parts


def test_many_numeric_attributes_are_compared_by_matrix_products(spark):
    rng = np.random.default_rng(3)
    points = (rng.integers(0, 3, (80, 9)) / 4).astype(float)
    rows = [(i, *map(float, p)) for i, p in enumerate(points)] + [(80, None, *[0.0] * 8), (81, float("nan"), *[0.0] * 8), (82, float("inf"), *[0.0] * 8)]
    dims = [Attr(f"v{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{a.name} double" for a in dims)).repartition(3)
    for group_rows in (10_000, 17):
        joined = ranges.range_join(df, df, "id", dims, 0.75, group_rows=group_rows)
        assert "FlatMapCoGroupsInPandas" in joined._jdf.queryExecution().executedPlan().toString()
        got = {(r.id, r.nb_id): r.distance for r in joined.collect()}
        exact = lambda a, b: sum((x - y) ** 2 for x, y in zip(points[a], points[b])) ** 0.5
        assert got == {(a, b): exact(a, b) for a in range(80) for b in range(80) if a != b and exact(a, b) <= 0.75}


def test_rounded_is_round(spark):
    r = random.Random(3)
    ties = [k / 10**6 + 5e-7 for k in range(400)] + [float(np.nextafter(k / 10**6 + 5e-7, s)) for k in range(400) for s in (0, 1)]
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, -1.23456789, 1e-12, 2.0**60, 999_999.9999995, 1e6, 1e300]
    values = ties + odd + [r.uniform(0, 10 ** r.randint(-6, 7)) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    both = df.select("d", F.round("d", 6).alias("want"), rounded("d").alias("got"))
    assert both.where(~F.col("want").eqNullSafe(F.col("got"))).collect() == []
    # Only what is near a tie is rounded through decimals: the plain branch is part of the plan.
    assert "floor" in both.select("got")._jdf.queryExecution().optimizedPlan().toString().lower()
