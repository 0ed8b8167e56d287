"""Range joins that send a row about once, and not to each bin or chunk it reaches."""

import random

import pytest
from pyspark.sql import functions as F

from farpoint import Attr
from farpoint.functions.distance import mixed_distance
from farpoint.operators import ranges

ATTRS = [Attr("v"), Attr("x"), Attr("t", "nominal", "String")]
SCHEMA = "id bigint, v double, x double, t string"


def odd_rows(n, seed):
    """A crowd in one place, copies, ids that come twice, and values without a distance."""
    r = random.Random(seed)
    rows = [(i, 3.0 if i % 4 == 0 else r.randint(-80, 80) / 4, r.randint(-30, 30) / 4, r.choice("abc")) for i in range(n)]
    odd = [(None, 1.0, 1.0, "a"), (900, None, 1.0, "a"), (901, 1.0, float("nan"), "a"), (902, float("inf"), 1.0, "a"), (903, 1.0, 1.0, None), (904, 1.0, 1.0, None)]
    return [*rows, *rows[:9], *odd, (905, 1e300, 1.0, "a"), (906, 1e300, -1e300, "a"), (906, 1e17, 1.25, "a")]


def crossed(left, right, radius, include_self, attrs=ATTRS):
    b = right.select(F.col("id").alias("nb_id"), *[F.col(c).alias(f"b_{c}") for c in ("v", "x", "t")])
    pairs = left.crossJoin(b).select("id", "nb_id", mixed_distance(attrs).alias("distance")).where(F.col("distance") <= radius)
    return pairs if include_self else pairs.where("id <> nb_id")


def listed(pairs):
    return sorted(map(tuple, pairs.collect()), key=str)


@pytest.mark.parametrize(
    "radius,binned,group_rows,include_self",
    [(0.5, 1, 10_000, True), (0.5, 2, 6, True), (1.5, 2, 10_000, False), (1.25, 2, 5, False), (2.0, 1, 7, True), (0.0, 2, 10_000, True)],
)
def test_pairs_are_those_of_a_cross_join(spark, monkeypatch, radius, binned, group_rows, include_self):
    monkeypatch.setattr(ranges, "SEARCH_ROWS", 20)
    monkeypatch.setattr(ranges, "TEST_PAIRS", 16)
    df = spark.createDataFrame(odd_rows(150, 1), SCHEMA).repartition(3)
    other = spark.createDataFrame(odd_rows(60, 2), SCHEMA).repartition(2)
    for left, right in ((df, df), (df, other)):
        got = ranges.range_join(left, right, "id", ATTRS, radius, include_self, binned, group_rows=group_rows)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert listed(got) == listed(crossed(left, right, radius, include_self))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ranges.range_join(df, df, "id", ATTRS, 0.5).collect() == []


@pytest.mark.parametrize("attrs,binned,most", [([Attr("v"), Attr("t", "nominal", "String")], 1, 1.2), (ATTRS, 2, 1.4)])
def test_a_row_is_sent_about_once(spark, monkeypatch, attrs, binned, most):
    """Before, it was sent once and again to two bins on each axis."""
    sent = []
    chunked = ranges._in_chunks
    monkeypatch.setattr(ranges, "_in_chunks", lambda *given: sent.append(chunked(*given)) or sent[-1])
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.uniform(0, 400), r.uniform(0, 400), "a") for i in range(2_000)], SCHEMA)
    got = ranges.range_join(df, df, "id", attrs, 0.5, binned=binned)
    assert listed(got) == listed(crossed(df, df, 0.5, False, attrs))
    assert 2_000 <= sent[0][0].count() <= most * 2_000


def test_other_types_are_joined(spark):
    df = spark.createDataFrame([(i, i % 5 / 4, 0.0, "a") for i in range(30)], SCHEMA).withColumn("t", F.array("t"))
    attrs = [Attr("v"), Attr("t", "nominal", "String")]
    got = ranges.range_join(df, df, "id", attrs, 0.25)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert listed(got) == listed(crossed(df, df, 0.25, False, attrs))
