"""Pseudonyms keep forms and validity, are permutations, and leave all other text alone."""

import datetime
import re

import pytest

from farpoint.llm import pseudonyms
from farpoint.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid_cards(n, first):
    """Numbers of 16 digits that pass the check of their last digit."""
    found, body = [], first
    while len(found) < n:
        found += [v for d in range(10) if luhn(v := f"{body}{d}")]
        body += 7919
    return found


def new_values(spark, values, key="k"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    got = {r.i: r for r in pseudonyms.pseudonymise(df, key=key).collect()}
    return [got[i].text for i in range(len(values))], [got[i].n_private for i in range(len(values))]


@pytest.mark.parametrize(
    ("make", "form"),
    [
        (lambda i: valid_cards(200, 400000000000000)[i], r"\d{16}"),
        (lambda i: " ".join(re.findall("....", valid_cards(200, 500000000000000)[i])), r"\d{4} \d{4} \d{4} \d{4}"),
        (lambda i: f"+1 (017) 555-{i:04d}", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        (lambda i: f"{100 + i}-12-3456", r"\d{3}-\d{2}-\d{4}"),
        (lambda i: f"10.0.{i % 256}.7", r"(?:\d{1,3}\.){3}\d{1,3}"),
        (lambda i: f"x.{i}@mail7.example.com", r"[a-z]\.\d+@[a-z]{4}\d\.[a-z]{7}\.com"),
        (lambda i: f"{i:040x}", r"[0-9a-f]{40}"),
        (lambda i: (datetime.date(1970, 1, 1) + datetime.timedelta(i)).isoformat(), r"\d{4}-\d\d-\d\d"),
        (lambda i: (datetime.date(1970, 1, 1) + datetime.timedelta(i)).strftime("%d.%m.%Y"), r"\d\d\.\d\d\.\d{4}"),
    ],
)
def test_forms(spark, make, form):
    old = [make(i) for i in range(200)]
    new, count = new_values(spark, old)
    assert set(count) == {1} and all(re.fullmatch(form, v) for v in new), [v for v in new if not re.fullmatch(form, v)][:3]
    assert len(set(new)) == 200 and sum(a == b for a, b in zip(old, new)) <= 1
    assert new != new_values(spark, old, key="other")[0]
    if form == r"\d{16}":
        assert all(map(luhn, old)) and all(map(luhn, new))


def test_same_value_in_other_writing_stays_linked(spark):
    new, _ = new_values(spark, ["4111111111111111", "4111-1111-1111-1111", "on 2001-02-03", "on 03.02.2001", "Ab@x.org", "aB@x.org"])
    assert luhn(new[0]) and new[0] == new[1].replace("-", "")
    assert new[2][3:] == "-".join(reversed(new[3][3:].split("."))) and new[4].lower() == new[5].lower()


def test_other_text_stays(spark):
    same = [None, "", "no such thing", "1.2.3", "999.1.1.1", "2001-02-30", "2001-13-01", "version 4.0.", "a @ b", "x" * 300_000, "12345", "\u00e9 1 2 3 @"]
    new, count = new_values(spark, same)
    assert new == same and count == [0] * len(same)
    mixed = "A\n 1.2.3.4. B\u00e9, (x@y.org) \U0001f600 4111111111111111!!\t2020-01-31"
    new, count = new_values(spark, [mixed, mixed])
    assert new[0] == new[1] and count == [4, 4]
    assert re.fullmatch("A\n (?:\\d+\\.){3}\\d+\\. B\u00e9, \\([a-z]@[a-z]\\.org\\) \U0001f600 \\d{16}!!\t\\d{4}-\\d\\d-\\d\\d", new[0])


def test_planted_values_are_gone(spark):
    kinds = r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?:\d{1,3}\.){3}\d{1,3}|\b[0-9a-f]{40}\b"
    old = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    total = 0
    for r in QUERIES["op3_pii_pseudonyms"](spark, FOLDER).collect():
        found = [v for v in re.findall(kinds, old[r.doc_id]) if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        total += len(found)
        assert not [v for v in found if v in r.text] and len(r.text) >= len(old[r.doc_id]) - 20 * len(found)
        if not found:
            assert r.text == old[r.doc_id]
    assert total > 5


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.org", 5)], "n_private int, text string, m int")
    got = pseudonyms.pseudonymise(df)
    assert got.columns == ["text", "m", "n_private"] and got.first().n_private == 1
    assert pseudonyms.pseudonymise(df.limit(0)).count() == 0
