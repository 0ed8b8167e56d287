"""SimHash classes against pairwise comparison of all fingerprints."""

import re

import numpy as np
import pytest
import xxhash

from farpoint.llm import simhash
from farpoint.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    if words and not shingles:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(ids, prints, k):
    """Smallest id reachable, by comparing every pair."""
    prints = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= k
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            least = min(root[j] for j in np.nonzero(near[i])[0])
            if least < root[i]:
                root[i], changed = least, True
    named = {r: min((ids[i] for i in range(len(ids)) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    return [named[r] for r in root]


def test_query_equals_all_pairs(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    expected = {(d.doc_id, f"{p:016x}", c) for d, p, c in zip(docs, prints, plain_classes([d.doc_id for d in docs], prints, 2))}
    assert {tuple(r) for r in QUERIES["op1_simhash_near_dedup"](spark, FOLDER).collect()} == expected


def test_edge_rows(spark):
    long = "one two three four " * 30_000
    rows = [(3, None, "x"), (1, "", "y"), (7, " \n ", None), (5, "Alone", "z"), (5, "Alone", "z"), (None, "aLONE", "n"), (9, long, "c"), (8, long, "c"), (None, "no id at all here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in simhash.simhash_classes(df).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (7, 1), (5, 5), (5, 5), (None, 5), (9, 8), (8, 8), (None, None)], key=str)
    kept = simhash.keep_first(df, simhash.simhash_classes(df))
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 5, 5, None, 8, None], key=str)
    assert simhash.simhash_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "key_rows"), [(1, 4096), (2, 4096), (2, 8), (3, 16), (5, 4096)])
def test_no_link_is_lost(spark, k, key_rows):
    """Dense groups of fingerprints, also with keys that are cut into chunks."""
    draw = np.random.default_rng(7)
    centres = draw.integers(0, 2**63, size=12, dtype=np.uint64)
    prints = set()
    for c in centres:
        for _ in range(40):
            flips = draw.choice(64, size=draw.integers(0, 8), replace=False)
            prints.add(int(c) ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "w0 long")
    edges = simhash.similar_fingerprints(df, 1, k, key_rows=key_rows).select("a.w0", "b.w0").collect()
    place = {simhash._signed(p): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        i, j = find(place[a]), find(place[b])
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= k
        root[max(i, j)] = min(i, j)
    ids = list(range(len(prints)))
    assert [find(i) for i in ids] == plain_classes(ids, prints, k)
