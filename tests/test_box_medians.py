"""Median partitioning of large tables, and line numbers, without a shuffle of their rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from farpoint.operators import boxes as bx
from farpoint.sources import boxes as source

SCHEMA = "id bigint, xMin bigint, yMin bigint, xMax bigint, yMax bigint"


def boxes(n, seed):
    """Few coordinates, so many boxes lie on a median, some without one."""
    r = random.Random(seed)
    draw = lambda: None if r.random() < 0.05 else r.randint(-3, 12)
    return [(i - 20, draw(), draw(), draw(), draw()) for i in range(n)]


def by_medians(rows, cutoff):
    """The leaf of each row, by sorting whole cells."""
    key = lambda axis: lambda r: [(v is not None, v or 0) for v in (r[1 + axis], r[0])]
    cells, axis = {1: rows}, 0
    while any(len(c) > cutoff for c in cells.values()):
        parts = {}
        for leaf, cell in cells.items():
            if len(cell) <= cutoff:
                parts[leaf] = cell
                continue
            cell = sorted(cell, key=key(axis % 4))
            low = (len(cell) + 1) // 2
            parts[2 * leaf], parts[2 * leaf + 1] = cell[:low], cell[low:]
        cells, axis = parts, axis + 1
    return {r[0]: leaf for leaf, cell in cells.items() for r in cell}


def leaves(df, cutoff, group_rows):
    return [(r.id, r.leaf_id) for r in bx.kd_partition(df, cutoff, group_rows).collect()]


def test_medians_are_counted_and_boxes_not_numbered(spark, monkeypatch):
    numbered = []
    number_rows = bx.number_rows
    monkeypatch.setattr(bx, "number_rows", lambda *args, **named: numbered.append(1) or number_rows(*args, **named))
    rows = boxes(210, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert dict(leaves(df, 9, 25)) == by_medians(rows, 9) and not numbered
    # Many coordinates, or many boxes on one: counts and ids are put in order in a distributed way.
    monkeypatch.setattr(bx, "BROADCAST_ROWS", 3)
    assert dict(leaves(df, 9, 100)) == by_medians(rows, 9) and numbered


def test_equal_boxes_on_both_sides_of_a_median(spark):
    rows = [*boxes(40, 2), *[(7, 5, 5, 6, 6)] * 90, *[(None, 1, 1, 2, 2)] * 30]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = leaves(df, 10, 20)
    assert Counter(i for i, _ in got) == Counter(r[0] for r in rows)
    assert max(Counter(leaf for _, leaf in got).values()) <= 10


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    path = str(tmp_path / "boxes")
    lines = [f"{i}\t{i}\t{i + 1}\t{i + 2}" for i in range(50)]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    read = source.read_boxes(spark, path)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(tuple(r) for r in read.collect()) == [(i, i, i, i + 1, i + 2) for i in range(50)]
    assert read.agg(F.countDistinct("id")).first()[0] == 50
