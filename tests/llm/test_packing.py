"""Packed pieces against whole-text encoding, and the packing's invariants."""

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from farpoint.llm import packing
from farpoint.llm.queries import QUERIES, table
from farpoint.llm.tokens import WordEncoder, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def check(rows, got, capacity):
    plain = Tokenizer.from_file(tokenizer_path())
    expected = []
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for number, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start : start + capacity], dtype="<u4")
            expected.append((doc, number, start, len(own), zlib.crc32(own.tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(expected, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= capacity
    return len(bins), sum(r["length"] for r in got)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    got = QUERIES["op8_best_fit_packing"](spark, FOLDER).select(*COLUMNS).collect()
    bins, total = check(rows, got, 4096)
    assert bins <= -(-total // 4096) + 1


def test_small_groups(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = packing.pack_documents(docs, group_pieces=20).select(*COLUMNS).collect()
    bins, total = check(rows, got, 4096)
    assert bins <= -(-total // 4096) + 3


def test_edge_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "w " * 9000), (4, " \n"), (8, "hello <|endoftext|> x <|EndOfText|>"), (5, "same"), (6, "same")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    check(rows, packing.pack_documents(df, capacity=64).select(*COLUMNS).collect(), 64)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_encoder_equals_whole_text():
    plain = Tokenizer.from_file(tokenizer_path())
    own = WordEncoder(tokenizer_path())
    texts = [
        "It's they'll'd 'S we''re. don\u2019t, ...",
        "H\u0331 \u0130stanbul I\u0307 \u1e9e \u03a3\u03a3 A\u030a \u212b caf\u00e9s, caf\u00e9. \u5317\u4eac 12,345.6 x\u00a0y\u2003z",
        "a\x1cb\x85c <|endoftext|> <|startoftext|>x <|ENDOFTEXT|> y<|endoftext|>z \ud55c\uae00 \u1112\u1161\u11ab \U0001f600\U0001f600!",
        "\u0e01\u0e33 \u0915\u094d\u0937 \u00b2\u2163 _a_b Zz.\tEnd,",
    ]
    for text in texts * 2:
        assert own.ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_local_search_beats_best_fit():
    draw = np.random.default_rng(5)
    for case in range(30):
        lengths = draw.integers(1, 60, size=60).tolist()
        bins = packing.Bins(list(lengths), 60)
        before = sum(1 for i in bins.items if i)
        squares = sum((60 - f) ** 2 for f in bins.free)
        bins.improve()
        placed = bins.placed()
        assert sorted(p[0] for p in placed) == list(range(60))
        assert len({p[1] for p in placed}) <= before and sum((60 - f) ** 2 for f in bins.free) >= squares
        assert all(0 <= f <= 60 for f in bins.free)
