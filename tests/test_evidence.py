"""Evidence by prefix sums and the schedule of checks, against plain versions; names and NULL keys."""

import random
from collections import defaultdict

import pytest

from farpoint import Attr, OutlierParams, WindowSpec
from farpoint.operators import evidence
from farpoint.operators.numbering import number_rows

ATTRS = [Attr("v"), Attr("t", "nominal", "String")]
SCHEMA = "u int, at int, v double, t string, n string, ds int, step int, c int"


def rows(n, seed, keys=(None, 1)):
    r = random.Random(seed)
    odd = [None, float("nan"), float("inf"), 1e300]
    value = lambda: r.choice(odd) if r.random() < 0.1 else r.randint(0, 12) / 2
    return [(r.choice(keys), i, value(), r.choice(["a", "b", None]), "n", 1, 2, 3) for i in range(n)]


def near(a, b, radius):
    if a[2] is None or b[2] is None or abs(a[2]) == float("inf") or abs(b[2]) == float("inf") or a[2] != a[2] or b[2] != b[2]:
        return False
    gap = (a[2] - b[2]) * (a[2] - b[2]) + (a[3] is None or b[3] is None or a[3] != b[3])
    return gap**0.5 <= radius


def by_key(data):
    groups = defaultdict(list)
    for row in data:
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize(("width", "slide", "k"), [(12, 3, 2), (9, 9, 1), (20, 1, 4)])
def test_minimal_evidence_and_triggers(spark, width, slide, k):
    data, spec, params = rows(120, 5), WindowSpec(width, slide), OutlierParams(1.0, k)
    walks, triggers = set(), set()
    for key, points in by_key(data).items():
        panes = width // slide
        for w in range(panes - 1, len(points) // slide):
            inside = range((w - panes + 1) * slide, (w + 1) * slide)
            for i in inside:
                own = i // slide
                hits = [j // slide for j in inside if j != i and near(points[i], points[j], 1.0)]
                succ = sum(s >= own for s in hits)
                if succ >= k:
                    continue
                prev, found = len(hits) - succ, succ
                status = "Unsafe" if succ + prev >= k else "Outlier"
                for s in sorted({s for s in hits if s < own}, reverse=True):
                    if found >= k:
                        break
                    found += hits.count(s)
                    walks.add((key, w, i + 1, s, hits.count(s), found, status))
                    least = s
                if status == "Unsafe":
                    triggers.add((key, w, i + 1, least))
    numbered = number_rows(spark.createDataFrame(data, SCHEMA), ["at"], ["u"])
    got = evidence.minimal_evidence(numbered, spec, ATTRS, params, ["u"]).collect()
    assert {tuple(r) for r in got} == walks and len(got) == len(walks)
    due = evidence.trigger_slide(numbered, spec, ATTRS, params, ["u"])
    assert {tuple(r) for r in due.collect()} == triggers
    checks = evidence.due_checks(due, due.selectExpr("u", "trigger_slide AS slide_id").distinct(), ["u"])
    assert {tuple(r) for r in checks.collect()} == {(u, s, q) for u, _, q, s in triggers}


def test_check_schedule(spark):
    data, width, k = rows(150, 6), 15, 3
    expected = set()
    for key, points in by_key(data).items():
        for i in range(len(points)):
            hits = [j for j in range(max(0, i - width + 1), min(len(points), i + width)) if j != i and near(points[i], points[j], 1.0)]
            at = i
            while at < len(points):
                succ = sum(i < j <= at for j in hits)
                prev = [j for j in hits if j < i and j > at - width]
                status = "Safe" if succ >= k else "Unsafe" if succ + len(prev) >= k else "Outlier"
                expected.add((key, i + 1, at + 1, status))
                if status != "Unsafe":
                    break
                at = sorted(prev)[-(k - succ)] + width
    numbered = number_rows(spark.createDataFrame(data, SCHEMA), ["at"], ["u"])
    got = evidence.check_schedule(numbered, width, ATTRS, OutlierParams(1.0, k), ["u"]).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert {s for *_, s in expected} == {"Safe", "Unsafe", "Outlier"}


def test_identity_columns_may_have_any_name(spark):
    numbered = number_rows(spark.createDataFrame(rows(60, 7), SCHEMA), ["at"])
    names = ["n", "ds", "step", "c", "at"]
    status = evidence.window_status(numbered, WindowSpec(12, 3), ATTRS, OutlierParams(1.0, 2), identity=names)
    assert status.columns == ["window_id", "seq", *names, "succ", "prev", "status"]
    assert {(r.n, r.ds, r.step, r.c, r["at"] + 1 == r.seq) for r in status.collect()} == {("n", 1, 2, 3, True)}
