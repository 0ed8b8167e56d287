"""The quality classifier on texts whose quality is known."""

import numpy as np

from farpoint.llm import quality
from farpoint.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.01"


def test_agrees_with_labels_it_has_not_seen(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    got = QUERIES["op2_quality_classifier"](spark, FOLDER).collect()
    assert len(got) == table(spark, FOLDER, "documents").count()
    pairs = [(labels[r.doc_id], r.keep) for r in got if r.doc_id in labels]
    good = [k for q, k in pairs if q == 1]
    bad = [k for q, k in pairs if q == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1, (np.mean(good), np.mean(bad))


def test_accuracies_are_found_from_agreement():
    """Votes drawn with known accuracies: the estimate needs no label."""
    draw = np.random.default_rng(2)
    truth = draw.random(20_000) < 0.8
    right = np.array([0.95, 0.85, 0.75, 0.65, 0.9])
    said = np.where(draw.random((len(truth), 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    said = np.where(draw.random(said.shape) < 0.3, quality.ABSTAIN, said)
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    found = model.chances[1][:, 1] / model.chances[1][:, :2].sum(axis=1)
    assert abs(model.prior - 0.8) < 0.03 and np.abs(found - right).max() < 0.05


def test_edge_rows(spark):
    good = "The cat sat on the mat and looked at the moon. It was a fine night for this in the town. " * 3
    rows = [(i, good + f"Day {i} of it.", 1.0) for i in range(60)] + [(100 + i, "BUY!! NOW### " * 30, 0.0) for i in range(10)]
    rows += [(200, None, 0.0), (201, "", 0.0), (202, "word", 0.0), (None, good, 0.0), (5, rows[5][1], 0.0), (203, good * 2000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    got = quality.classify(df)
    assert got.columns == ["doc_id", "text", "quality", "keep"]
    kept = [(r.doc_id, r.keep) for r in got.collect()]
    assert len(kept) == len(rows) and all(k for d, k in kept if d is None or d < 100 or d >= 200)
    assert not any(k for d, k in kept if d is not None and 100 <= d < 200)
    assert quality.classify(df.limit(0)).count() == 0
