import random

import brute
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from farpoint.operators import boxes as bx
from farpoint.plans.boxes import partition_job, search_job
from farpoint.sources.boxes import read_boxes

SCHEMA = "id bigint, xMin bigint, yMin bigint, xMax bigint, yMax bigint"


def random_boxes(n, seed, giant=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = r.randint(-60, 60), r.randint(-60, 60)
        if i % 3 == 0:
            x, y = 5, 5  # crowded corner
        rows.append((i, x, y, x + r.randint(1, 9), y + r.randint(1, 9)))
    if giant:
        rows += [(n, -500, -500, 500, 500), (n + 1, -40, 0, 90, 3), (n + 2, 0, 0, 1, 1), (n + 3, 0, 0, 1, 1)]
    return rows


@pytest.mark.parametrize("cell,group_rows", [(64, 10_000), (4, 10_000), (8, 6)])
def test_box_join(spark, cell, group_rows):
    rows = random_boxes(90, cell)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pairs = [(r.id, r.hit) for r in bx.box_join(df, df, cell, group_rows=group_rows).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute.box_pairs(rows)
    assert bx.total_hits(df, cell, group_rows).first().total_hits == len(pairs)


def test_touching_and_nested_boxes_and_hits(spark):
    rows = [(1, 0, 0, 2, 2), (2, 2, 0, 4, 2), (3, 4, 2, 6, 6), (4, 5, 3, 6, 4), (5, 100, 100, 101, 101), (6, 0, 0, 2, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    hits = {r.id: r.hits for r in bx.box_hits(bx.box_join(df, df, 2)).collect()}
    assert hits == {1: [2, 6], 2: [1, 3, 6], 3: [2, 4], 4: [3], 6: [1, 2]}
    all_hits = {r.id: r.hits for r in bx.box_hits(bx.box_join(df, df, 2), df).collect()}
    assert all_hits == hits | {5: []}


def test_tiles_multiply_hits(spark):
    rows = random_boxes(60, 8, giant=False)
    df = spark.createDataFrame(rows, SCHEMA)
    base = bx.total_hits(df, 8).first().total_hits
    tiled = bx.tile_boxes(df, 2)
    assert tiled.count() == tiled.select("id").distinct().count() == 4 * len(rows)
    assert bx.total_hits(tiled, 8).first().total_hits == 4 * base == 4 * len(brute.box_pairs(rows))


@pytest.mark.parametrize("cutoff", [5, 40])
def test_median_partition(spark, cutoff):
    rows = random_boxes(100, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    local = {r.id: r.leaf_id for r in bx.kd_partition(df, cutoff).collect()}
    spread = {r.id: r.leaf_id for r in bx.kd_partition(df, cutoff, group_rows=30).collect()}
    assert local == spread and len(local) == len(rows)

    def split(members, leaf, axis):
        if len(members) <= cutoff:
            return {m[0]: leaf for m in members}
        members = sorted(members, key=lambda m: (m[1 + axis % 4], m[0]))
        middle = (len(members) + 1) // 2
        return split(members[:middle], leaf * 2, axis + 1) | split(members[middle:], leaf * 2 + 1, axis + 1)

    assert local == split(rows, 1, 0)
    regions = bx.leaf_regions(bx.kd_partition(df, cutoff)).collect()
    assert sum(r.boxes for r in regions) == len(rows) and max(r.boxes for r in regions) <= cutoff
    pairs = bx.box_join_regions(df, df, cutoff, cell=16)
    assert sorted((r.id, r.hit) for r in pairs.collect()) == sorted(brute.box_pairs(rows))


def test_box_files(spark, tmp_path):
    rows = random_boxes(30, 2, giant=False)
    folder = tmp_path / "boxes"
    folder.mkdir()
    for part, chunk in enumerate((rows[:12], rows[12:])):
        (folder / f"{part}.txt").write_text("".join("\t".join(map(str, r[1:])) + "\n" for r in chunk))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        assert sorted(tuple(r) for r in read_boxes(spark, str(folder)).collect()) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    leaves, regions = partition_job(spark, str(folder), 8)
    assert leaves.count() == 30 and regions.agg(F.sum("boxes")).first()[0] == 30
    found = {(r.id, h) for r in search_job(spark, str(folder), 8).collect() for h in r.hits}
    assert found == brute.box_pairs(rows)


def test_illegal_boxes(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, 1), (2, 3, 0, 3, 1), (3, 0, 5, 1, 4)], SCHEMA)
    assert [r.id for r in bx.validate_boxes(df, "drop").collect()] == [1]
    assert sorted(r.id for r in bx.validate_boxes(df, "only").collect()) == [2, 3]
    with pytest.raises(PySparkException, match="illegal bounding box"):
        bx.validate_boxes(df).collect()


@pytest.mark.parametrize("group_rows", [10_000, 4])
def test_hits_are_collected_where_the_query_is(spark, group_rows, monkeypatch):
    r = random.Random(8)
    rows = [(i, x, y, x + 1 + r.randint(0, 3), y + 1 + r.randint(0, 5)) for i in range(60) for x, y in [(r.randint(-20, 20), r.randint(-9, 9))]]
    rows += [rows[7], (9, 500, 500, 501, 501), (None, 0, 0, 2, 2), (200, None, 0, 2, 2), (201, 900, 0, 901, 2), (202, 5, 5, 3, 9)]
    df = spark.createDataFrame(rows, "id bigint, xMin bigint, yMin bigint, xMax bigint, yMax bigint").repartition(3)
    monkeypatch.setattr(bx, "TASK_PAIRS", 100, raising=False)
    as_rows = lambda found: sorted((x.id if x.id is not None else -1, tuple(x.hits)) for x in found.collect())
    apart = bx.box_join(df, df, group_rows=group_rows)
    near = bx.box_join(df, df, group_rows=group_rows, together=True)
    assert as_rows(bx.box_hits(near)) == as_rows(bx.box_hits(apart))
    assert as_rows(bx.box_hits(near, df)) == as_rows(bx.box_hits(apart, df))
    unique = df.where("id <> 7 AND id <> 9")
    plan = bx.box_hits(bx.box_join(unique, unique, together=True))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan
