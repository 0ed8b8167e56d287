"""Hits of boxes without pairs that are formed or shuffled."""

import random

import brute
import pytest

from farpoint.operators import boxes as bx

SCHEMA = "id bigint, xMin bigint, yMin bigint, xMax bigint, yMax bigint"


def crowd(n, seed, widest=9):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (5, -5) if i % 3 == 0 else (r.randint(-40, 40), r.randint(-40, 40))
        rows.append((i, x, y, x + r.randint(0, widest), y + r.randint(0, widest)))
    return rows


def odd(rows):
    """Rows that come twice, ids that several boxes share, NULLs and turned boxes."""
    turned = [(900 + i, x1, y0, x0, y1) for i, x0, y0, x1, y1 in rows[:20]]
    return [*rows, *rows[:10], *[(7, *r[1:]) for r in rows[20:30]], *[(None, *r[1:]) for r in rows[30:40]], (950, None, 0, 3, 3), (951, 0, 0, 3, None), *turned]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell,rows", [(None, crowd(120, 1)), (16, crowd(150, 2)), (4, crowd(90, 3, 3)), (None, odd(crowd(100, 4))), (None, [])])
def test_total_hits_are_counted_without_pairs(spark, cell, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counted = bx.total_hits(df, cell)
    joined = bx.total_hits(df.selectExpr("id", *[f"cast({a} AS double) AS {a}" for a in bx.AXES]), cell)
    assert "MapInArrow" in plan(counted) and "MapInArrow" not in plan(joined)
    assert counted.first().total_hits == joined.first().total_hits
    if rows and not any(None in r for r in rows):
        assert counted.first().total_hits == len(brute.box_pairs(rows))


def test_wide_boxes_are_joined(spark):
    rows = [*crowd(60, 5), (60, -500, -500, 500, 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert bx.total_hits(df).first().total_hits == len(brute.box_pairs(rows))


@pytest.mark.parametrize("rows,cell,block", [(crowd(200, 6), None, 2_000), (crowd(200, 7), 4, 7), (odd(crowd(100, 8)), None, 50), ([], None, 50)])
def test_region_hits_shuffle_no_pairs(spark, rows, cell, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bx.region_hits(df, df, 10, cell, block_queries=block)
    wanted = bx.box_hits(bx.box_join_regions(df, df, 10, cell))
    assert got.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
