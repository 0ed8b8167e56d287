"""The pipeline stage by stage against plain versions of what each stage has to do with its input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

import corpus_pipeline
from farpoint.llm.queries import table
from tests.llm.test_line_dedup import plain
from tests.llm.test_mixing import plain_targets
from tests.llm.test_packing import check
from tests.llm.test_shingle_sets import plain_classes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of each stage."""
    docs, found = table(spark, FOLDER, "documents"), []
    schema = docs.schema
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, FOLDER)
        rows = made.collect()
        if number + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == schema.names, name
        found.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, schema) if number + 1 < len(corpus_pipeline.STAGES) else None
    return found


def test_classifier_drops_rows_and_keeps_clean_ones(spark, steps):
    before, after = steps[0]
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before)) and 0 < len(after) < len(before)
    kept = {r.doc_id for r in after}
    quality = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    good = [i in kept for i, q in quality.items() if q == 1]
    bad = [i in kept for i, q in quality.items() if q == 0]
    assert np.mean(good) >= 0.95 and (not bad or np.mean(bad) <= 0.2), (np.mean(good), bad)


def test_lines(steps):
    before, after = steps[1]
    expected = Counter((doc, text) for doc, text, _, _ in plain([(r.doc_id, r.text) for r in before]))
    assert Counter((r.doc_id, r.text) for r in after) == expected
    assert all(r.n_chars == len(r.text) for r in after)
    others = lambda rows: Counter((r.doc_id, r.lang, r.source) for r in rows)
    assert others(before) == others(after)


def test_near_copies(steps):
    before, after = steps[2]
    classes = plain_classes([(r.doc_id, r.text) for r in before])
    first = {c: min(i for i, x in classes.items() if x == c) for c in set(classes.values())}
    expected = [r for r in before if first[classes[r.doc_id]] == r.doc_id]
    assert len({r.doc_id for r in before}) == len(before)
    assert Counter(map(tuple, after)) == Counter(map(tuple, expected)) and len(after) < len(before)


def test_mix(steps):
    before, after = steps[3]
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    for r in after:
        taken[r.source] += size(r.text)
    given = Counter(map(tuple, before))
    assert all(n <= 3 * given[r] for r, n in Counter(map(tuple, after)).items())
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= max(largest[source] / 2 + 1, 0.02 * target)


def test_packing(steps):
    before, after = steps[4]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins, total = check([(r.doc_id, r.text) for r in before], [Row(**{n: r[n] for n in names}) for r in after], 4096)
    assert bins <= -(-total // 4096) + 1


def test_run_gives_what_the_stages_give(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    pieces = lambda rows: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(got) == pieces(steps[4][1])
