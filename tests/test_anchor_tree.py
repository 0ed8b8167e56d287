"""Two levels of anchors against comparison of all pairs."""

import numpy as np
import pytest

from farpoint.operators import anchor_tree as anchor_module
from farpoint.operators.anchor_tree import anchor_tree, anchor_tree_join

SCHEMA = "id long, v array<double>"


@pytest.mark.parametrize("group_rows, shift", [(10_000, 0.0), (40, 0.0), (10_000, 1e7)])
def test_pairs_equal_brute_force(spark, group_rows, shift):
    draw = np.random.default_rng(2)
    data = np.concatenate([draw.standard_normal((120, 3)), 0.2 * draw.standard_normal((150, 3)) + 5, np.ones((20, 3)), [[1e3, 0, 0], [1e3, 0.5, 0]]]) + shift
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, [1.0, None, 0.0]), (902, [float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    tops = spark.createDataFrame([rows[0], rows[5], rows[200]], SCHEMA)
    got = {(r.id, r.nb_id): r.distance for r in anchor_tree_join(df, tops, "id", "v", 0.6, group_rows=group_rows).collect()}
    away = np.sqrt(((data[:, None] - data[None]) ** 2).sum(axis=2))
    expected = {(int(i), int(j)): away[i, j] for i, j in zip(*np.nonzero(away <= 0.6)) if i != j}
    assert got.keys() == expected.keys()
    assert all(got[p] == pytest.approx(expected[p], abs=1e-12) for p in got)


def test_leaves_and_empty_table(spark):
    df = spark.createDataFrame([(i, [float(i % 50), 0.0]) for i in range(400)], SCHEMA)
    members, leaves = anchor_tree(df, df.where("id = 0"), "id", "v")
    anchors = {r._leaf: r._anchor for r in leaves.collect()}
    assert len(anchors) >= 1
    found = members.collect()
    assert sorted(r._id for r in found) == list(range(400))
    for r in found:
        assert r._d == pytest.approx(min(abs(r._v[0] - a[0]) for a in anchors.values()), abs=1e-6)
    assert anchor_tree_join(df.limit(0), df.where("id = 0"), "id", "v", 1.0).count() == 0


@pytest.mark.parametrize("group_rows, bundles", [(10_000, 1), (250, 5)])
def test_a_point_is_sent_once_to_a_bundle_of_leaves(spark, monkeypatch, group_rows, bundles):
    draw = np.random.default_rng(5)
    data = draw.standard_normal((600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SCHEMA)
    written = {}
    kept = anchor_module.materialize
    monkeypatch.setattr(anchor_module, "materialize", lambda frame, label: written.setdefault(label, kept(frame, label)))
    got = {(r.id, r.nb_id) for r in anchor_tree_join(df, df.where("id = 0"), "id", "v", 4.0, group_rows=group_rows).collect()}
    away = np.sqrt(((data[:, None] - data[None]) ** 2).sum(axis=2))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(away <= 4.0)) if i != j}
    assert written["bundles"].count() > bundles
    assert written["visits"].count() <= bundles * len(data)


def test_a_point_is_written_once_and_meets_each_bundle_once(spark, monkeypatch):
    """Before, a point was written and sent once for each bundle of each chunk, with its distances to all leaves."""
    draw = np.random.default_rng(6)
    data = np.concatenate([draw.standard_normal((300, 8)), np.ones((150, 8)), draw.standard_normal((150, 8)) + 3])
    big = 2**60
    rows = [(big + i, v.tolist()) for i, v in enumerate(data)] + [(None, data[0].tolist()), (big, data[1].tolist())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    written = {}
    kept = anchor_module.materialize
    monkeypatch.setattr(anchor_module, "materialize", lambda frame, label: written.setdefault(label, kept(frame, label)))
    tops = spark.createDataFrame([rows[0], rows[500]], SCHEMA)
    got = sorted(map(tuple, anchor_tree_join(df, tops, "id", "v", 1.5, group_rows=60).collect()))
    assert written["visits"].count() == len(rows) - 1 and "_leaves" not in written["visits"].columns
    # A leaf of copies is cut into chunks.
    sizes = [r["count"] for r in written["bundles"].groupBy("_leaf").count().collect()]
    assert max(sizes) >= 3
    ids = [r[0] for r in rows if r[0] is not None]
    vectors = np.array([r[1] for r in rows if r[0] is not None])
    away = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    expected = sorted((ids[i], ids[j]) for i, j in zip(*np.nonzero(away <= 1.5)) if ids[i] != ids[j])
    assert [g[:2] for g in got] == expected
    monkeypatch.undo()
    among = anchor_tree_join(df.where("id IS NOT NULL"), tops, "id", "v", 1.5, include_self=True, group_rows=60).count()
    assert among == int((away <= 1.5).sum())
