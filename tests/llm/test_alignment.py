"""Aligned documents against whole-text encoding, one document after the other."""

import hashlib
import random
from bisect import bisect_left, bisect_right
from collections import Counter

import pytest

from farpoint.llm import alignment
from farpoint.llm.queries import QUERIES, table
from farpoint.llm.tokens import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    return alignment.WordAligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def spans(ids, parts):
    end, out = 0, []
    for i in ids:
        out.append((i, end, end + len(parts[i])))
        end += len(parts[i])
    return out


def brute(rows, tools):
    """Groups by shared ends and links by overlap of byte ranges, from the ids of whole texts."""
    links, shown = {}, {}
    for n, (_, text) in enumerate(rows):
        if not text:
            continue
        raw = (" " + text).encode()
        a = spans(tools.a.encode(" " + text, add_special_tokens=False).ids, tools.bytes_a)
        b = spans(tools.b.encode(text), tools.bytes_b)
        if b"".join(tools.bytes_a[i] for i, *_ in a) != raw or b"".join(tools.bytes_b[i] for i, *_ in b) != raw:
            continue
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        edges = [[e for *_, e in tokens] for tokens in (a, b)]
        side = lambda k, x, y: ",".join(str(i) for i, *_ in (a, b)[k][bisect_right(edges[k], x) : bisect_right(edges[k], y)])
        groups = [f"{side(0, x, y)}|{side(1, x, y)}" for x, y in zip([0, *ends], ends)]
        starts, stops = [u for _, u, _ in b], [v for *_, v in b]
        links[n] = [(i, j) for i, x, y in a for j, *_ in b[bisect_right(stops, x) : bisect_left(starts, y)]]
        shown[n] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(p for some in links.values() for p in some)
    top = Counter()
    for (_, j), c in counts.items():
        top[j] = max(top[j], c)
    out = []
    for n, (doc, _) in enumerate(rows):
        a, b, g, sha = shown.get(n, (0, 0, 0, ""))
        some = links.get(n, [])
        out.append((doc, a, b, g, len(some), sum(counts[p] == top[p[1]] for p in some), sum(counts[p] for p in some), sha))
    return Counter(out)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b"), (5, "x\n y\n\n  z \n"), (6, "U+2581 ▁ here"), (7, "<|endoftext|> <s> <unk> </s> <0x41>"),
    (8, "don't we'll 123 4,5"), (9, "é é ﬁ 你好 \U0001f642"), (10, "tab\tend "), (11, "same same"), (11, "same same"), (None, "same same"),
    (12, "\x00 \x1c x\x1c y"), (13, "  a  b　c"), (14, "w" * 300 + " " + "v" * 300), (15, "\r\n a\r\n"), (16, "  lead"),
]


def test_odd_texts(spark, tools):
    rows = ODD + [(100 + i, "same same") for i in range(300)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_a string, _key int")
    assert Counter(tuple(r) for r in alignment.align_documents(df).collect()) == brute(rows, tools)


def test_random_texts(spark, tools):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["a", "the", " ", " ", "  ", "\n", "\t", ".", "'s", "7", "é", "\u00a0", "\x1c", "▁", "😀"]) for _ in range(r.randint(1, 14)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in alignment.align_documents(df).collect()) == brute(rows, tools)


def test_long_text(spark, tools):
    rows = [(i, f"word{i % 7} common 'tis " * 400 + "end" * (i % 3)) for i in range(24)] + [(99, "long " * 100_000), (100, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in alignment.align_documents(df).collect()) == brute(rows, tools)


def test_block_size_does_not_matter(spark, tools):
    rows = [(("k%d" % i).encode(), 1, i + 1, f"alpha beta{i} gamma alpha") for i in range(6)]
    whole = alignment._align_block(0, rows, tools).to_pylist()[0]
    parts = [alignment._align_block(i, [r], tools).to_pylist()[0] for i, r in enumerate(rows)]
    total = Counter()
    for p in parts:
        total.update(dict(zip(p["pairs"], p["weights"])))
    assert total == Counter(dict(zip(whole["pairs"], whole["weights"])))


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, tools):
    rows = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    assert Counter(tuple(r) for r in QUERIES["op11_tokenizer_alignment"](spark, FOLDER).collect()) == brute(rows, tools)
