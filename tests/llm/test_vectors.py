"""Nearest neighbours and near-duplicate vectors against comparison of all pairs."""

import numpy as np
import pytest

from farpoint.llm import collision_ann, sorted_passes
from farpoint.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, _v int"


def test_recall_on_the_table(spark):
    rows = table(spark, FOLDER, "embeddings").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op6_nearest_neighbours"](spark, FOLDER).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        score = data @ data[ids == q][0]
        order = sorted((-s, i) for s, i in zip(score, ids.tolist()) if i != q)
        hits += len({i for _, i in order[:20]} & {v for v, _ in found.values()})
        for rank, (v, s) in found.items():
            assert s == pytest.approx(score[ids == v][0], abs=1e-12)
        ordered = [found[r] for r in range(1, 21)]
        assert ordered == sorted(ordered, key=lambda x: (-x[1], x[0]))
    assert hits / (20 * len(got)) >= 0.95


def test_recall_in_blocks_of_unlike_lengths(spark):
    draw = np.random.default_rng(4)
    data = draw.standard_normal((1500, 16)) * draw.lognormal(0, 1, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, score int")
    got = collision_ann.nearest_by_collisions(df, df.where("vec_id % 20 = 0"), k=10, index_rows=300, query_rows=20).collect()
    hits = 0
    for q in range(0, 1500, 20):
        score = data @ data[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 750 and hits / 750 >= 0.9


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (0, [0.0, 2.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (None, [1.0, 0.0], 0), (10, [3.0, 0.1], 0), (11, [1.0], 0), (20, [2.0, 0.0], 0)]


def test_nearest_edge_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = [tuple(r) for r in collision_ann.nearest_by_collisions(df, df.where("vec_id % 20 = 0"), k=20).collect()]
    expected = [(20, 1, 10, 6.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 0, 0.0)]
    expected += [(0, 1, 10, pytest.approx(0.2)), (0, 2, 1, 0.0), (0, 3, 2, 0.0), (0, 4, 20, 0.0)]
    assert sorted(got) == sorted(expected, key=lambda t: t[:2])
    assert collision_ann.nearest_by_collisions(df.limit(0), df.limit(0)).count() == 0


def plain_links(ids, data, threshold=0.95):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        least = np.array([min(root[i], root[near[i]].min()) if near[i].any() else root[i] for i in range(len(ids))])
        if (least == root).all():
            return near.sum(axis=1), root
        root = least


@pytest.mark.parametrize("chunk", [1024, 50])
def test_crowds_lose_no_link(spark, chunk):
    """Groups from pairs to hundreds, far more than a window, with equal vectors among them."""
    draw = np.random.default_rng(9)
    parts = [draw.standard_normal((500, 32))]
    for size, noise in ((300, 0.1), (40, 0.15), (2, 0.2), (2, 0.2), (5, 0.2), (60, 0.21)):
        centre = draw.standard_normal(32)
        parts.append(centre + noise * draw.standard_normal((size, 32)))
    parts.append(np.repeat(parts[1][:1], 50, axis=0))
    data = np.concatenate(parts)
    ids = draw.permutation(len(data))
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, data)], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in sorted_passes.near_duplicate_vectors(df, chunk=chunk).collect()}
    links, roots = plain_links(ids.tolist(), data)
    expected = {int(i): (int(n), int(c), int(c) == int(i)) for i, n, c in zip(ids, links, roots)}
    wrong = [i for i in expected if got[i] != expected[i]]
    assert len(wrong) <= 0.01 * len(expected), [(got[i], expected[i]) for i in wrong[:5]]
    assert all(got[i][0] <= expected[i][0] for i in expected)


def test_near_duplicate_edge_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = sorted((tuple(r) for r in sorted_passes.near_duplicate_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (0, 4, 5, 6, 7, 8, 9, 11)] + [(None, 0, None, True)]
    assert got == sorted(alone + [(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False), (20, 3, 1, False)], key=str)
    assert sorted_passes.near_duplicate_vectors(df.limit(0)).count() == 0


def crowd(cosine, rows, pairs, dimension=32, seed=3):
    """Vectors around one direction at about ``cosine`` with each other, even ones, and near pairs inside the crowd."""
    draw = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(draw.standard_normal(dimension))

    def around(number):
        away = draw.standard_normal((number, dimension))
        return centre * cosine**0.5 + unit(away - np.outer(away @ centre, centre)) * (1 - cosine) ** 0.5

    chosen = around(pairs)
    away = draw.standard_normal((pairs, dimension))
    away = unit(away - np.einsum("ij,ij->i", away, chosen)[:, None] * chosen)
    data = np.concatenate([around(rows), chosen, chosen * 0.956 + away * (1 - 0.956**2) ** 0.5, draw.standard_normal((2 * rows, dimension))])
    return data[draw.permutation(len(data))]


@pytest.mark.parametrize("cosine", [0.7, 0.85, 0.9])
def test_crowd_below_the_threshold(spark, cosine):
    data = crowd(cosine, 1500, 100)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in sorted_passes.near_duplicate_vectors(df).collect()}
    links, roots = plain_links(list(range(len(data))), data)
    assert links.sum() >= 200
    assert sum(n for n, _ in got.values()) >= 0.98 * links.sum()
    assert all(got[i][0] <= links[i] for i in got)
    assert sum(got[i][1] != roots[i] for i in got) <= 0.02 * links.sum()


@pytest.mark.parametrize("chunk", [50, 1000])
def test_runs_of_classes_and_single_rows(spark, chunk):
    """Every two classes of a long run that link are tied, whether they have chunks of their own or share some."""
    data = np.concatenate([crowd(0.9, 150, 20, 16), np.repeat(crowd(0.9, 1, 0, 16)[:1], 120, axis=0) + np.random.default_rng(1).normal(0, 0.01, (120, 16))])
    rows = [(i, 1, 16, 0, i if i < len(data) - 120 else len(data) - 120, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "_id long, _pass int, _length int, _code long, _class long, _v array<double>")
    got = sorted_passes._run_links(df.drop("_v"), df.select("_id", "_v"), 0, 0.95, 16, chunk)
    from farpoint.llm.components import connected_components

    found = {r.node: r.root for r in connected_components(got).collect()}
    _, roots = plain_links(list(range(len(data))), data)
    for r in rows:
        assert found.get(r[4], r[4]) == roots[r[0]]


def test_unlike_vectors_under_one_id(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [1.0, 0.01]), (1, [0.01, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in sorted_passes.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1, True), (3, 1, 1, False), (3, 1, 3, True), (5, 1, 3, False)]
