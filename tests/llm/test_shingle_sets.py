"""Jaccard classes of shingle sets against pairwise comparison of all sets."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from farpoint.llm import shingle_sets
from farpoint.llm.components import connected_components


def plain_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def plain_classes(rows):
    """Smallest id reachable, by comparing every pair of sets."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: min(rows[j][0] for j in range(len(rows)) if find(j) == find(k)) for k, (i, _) in enumerate(rows)}


def changed_tail(draw, words, shared, extra):
    """A text that keeps so many shingles of another at its start, and has others after them."""
    return words[: shared + 4] + [f"n{draw.random()}" for _ in range(extra)]


def pairs_of_texts(size, shared, number, seed):
    draw, rows = random.Random(seed), []
    for _ in range(number):
        first = [f"w{draw.random()}" for _ in range(size + 4)]
        rows += [first, changed_tail(draw, first, shared, size - shared)]
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


def near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}


def test_pairs_below_the_similarity_stay(spark):
    """Pairs at 0.70 to 0.79: the rule of 25 unlike bits dropped most of them."""
    rows = [(i + 1000 * k, t) for k, shared in enumerate([83, 86, 88]) for i, t in pairs_of_texts(100, shared, 40, k)]
    assert near(spark, rows) == {i for i, _ in rows}


@pytest.mark.parametrize(("size", "shared"), [(99, 88), (400, 356), (9, 8), (1000, 889)])
def test_every_pair_at_the_similarity_is_found(spark, size, shared):
    """Pairs just at 0.8, each without a third text between them, as brute force finds them."""
    assert 0.8 <= shared / (2 * size - shared) < 0.804
    rows = pairs_of_texts(size, shared, 150, size)
    assert near(spark, rows) == {i for i, _ in rows if i % 2 == 0}


@pytest.mark.parametrize("key_rows", [4096, 8])
def test_crowds_and_edge_rows(spark, key_rows):
    """Groups of many near copies, of near misses and of copies, also with keys cut into chunks."""
    draw, texts = random.Random(5), [None, "", " \n ", "Alone", "aLONE", "a b c d", "x " * 5000, "x " * 6000]
    for rate in (0.005, 0.01, 0.03):
        base = [f"w{draw.random()}" for _ in range(120)]
        texts += [" ".join(w if draw.random() > rate else f"v{draw.random()}" for w in base) for _ in range(40)]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingle_sets.jaccard_classes(df, key_rows=key_rows).collect()
    expected = plain_classes(rows)
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == expected
    assert max(Counter(expected.values()).values()) > 20


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one"), (3, "One"), (3, "one"), (None, "two")], "doc_id long, text string")
    got = shingle_sets.jaccard_classes(df).collect()
    assert Counter(map(tuple, got)) == Counter([(None, 3), (3, 3), (3, 3), (None, None)])
    assert shingle_sets.jaccard_classes(df.limit(0)).count() == 0


def test_crowd_of_loose_copies(spark):
    """Many copies of one text with words changed, whose pairs lie on both sides of the similarity, by a matrix of all sets."""
    draw = random.Random(9)
    base = [f"w{draw.random()}" for _ in range(150)]
    texts = [" ".join(w if draw.random() > 0.02 else f"v{draw.random()}" for w in base) for _ in range(2000)]
    got = shingle_sets.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [plain_set(t) for t in texts]
    often = [s for s, n in Counter(s for one in sets for s in one).items() if n > 1]
    place = {s: i for i, s in enumerate(often)}
    held = np.zeros((len(sets), len(often)), dtype=np.float32)
    for i, one in enumerate(sets):
        held[i, [place[s] for s in one if s in place]] = 1
    size, shared = np.array([len(s) for s in sets]), held @ held.T
    link, root = 9 * shared >= 4 * (size[:, None] + size[None, :]), np.arange(len(sets))
    while True:
        least = np.where(link, root[None, :], len(sets)).min(axis=1)
        if (np.minimum(least, root) == root).all():
            break
        root = np.minimum(least, root)
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root.tolist()))
    assert max(Counter(root.tolist()).values()) > 20


def test_all_words_of_a_sketch_decide_on_candidates(spark):
    """Sets that share a hash and half of their bits only are no candidates; two words of four let them pass."""
    rows = [(0, 0, 10, 5, 5, 0, 0, [7]), (1, 1, 10, 5, 5, -1, -1, [7]), (2, 2, 10, 5, 5, 0, 3, [7])]
    sets = spark.createDataFrame(rows, "n long, c long, size long, w0 long, w1 long, w2 long, w3 long, prefix array<long>")
    found = shingle_sets._shingle_pairs(sets, shingle_sets.KEY_ROWS)
    assert [tuple(r) for r in found.collect()] == [(0, 2)]


def test_pairs_of_a_crowd_grow_with_its_sets(spark):
    """Sets of different classes that are all near each other: all their pairs were made, with the square of their number."""
    number = 300
    rows = [(i, i, 10, 5, 5, 0, 0, [7]) for i in range(number)]
    sets = spark.createDataFrame(rows, "n long, c long, size long, w0 long, w1 long, w2 long, w3 long, prefix array<long>")
    for key_rows in (shingle_sets.KEY_ROWS, 512):
        found = [tuple(r) for r in shingle_sets._shingle_pairs(sets, key_rows).collect()]
        assert len(found) <= 2 * number and {n for pair in found for n in pair} == set(range(number))


def test_rarest_links_join_what_all_links_join(spark, monkeypatch):
    """Loose copies of three texts in classes of their own, with groups cut into chunks."""
    monkeypatch.setattr(shingle_sets, "GROUP_SETS", 8)
    draw, texts = random.Random(21), []
    for rate in (0.015, 0.02, 0.03):
        base = [f"w{draw.random()}" for _ in range(90)]
        texts += [" ".join(w if draw.random() > rate else f"v{draw.random()}" for w in base) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = shingle_sets.shingle_prints(docs, "doc_id", "text", 5).withColumnRenamed("doc_id", "n")
    sets = prints.select("n", F.col("n").alias("c"), "size", *shingle_sets.word_columns(shingle_sets.WORDS), F.struct("t0", "t1").alias("t"))
    everyone = docs.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    links = shingle_sets._rarest_links(sets, shingle_sets._sets_of(everyone, sets, docs, "text", 5))
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == plain_classes(list(enumerate(texts)))
    assert len(set(got.values())) >= 3
