"""Keyed stream state: many keys judged together, in few calls."""

import random

import pytest

from farpoint.streaming import keyed
from tests.test_streaming import ATTRS, PARAMS, SPEC, batches, feed, in_batch, rows


def run(stream, tmp_path, spark):
    status = keyed.stream_outliers_keyed(stream, "u", ["at"], ATTRS, SPEC, PARAMS, ["at"])
    out = str(tmp_path / "out")
    writer = status.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(status.schema).parquet(out).collect()]


@pytest.mark.parametrize("groups,pairs", [(1, 1 << 20), (2, 300)])
def test_keys_of_a_group_are_judged_apart(spark, tmp_path, monkeypatch, groups, pairs):
    """Several keys in one group, one without a value, some only in later batches; late rows of one and not of others."""
    monkeypatch.setattr(keyed, "KEY_GROUPS", groups)
    monkeypatch.setattr(keyed, "PAIRS", pairs)
    r = random.Random(7)
    data = [(r.choice([0, 1, 2, None]) if i < 90 else r.choice([1, 2, 5, None]), *row[1:]) for i, row in enumerate(rows(180, 7))]
    late = [(0, 1, 9.0, "a"), (None, 2, 8.0, "a"), (2, -4, 7.0, None)]
    parts = batches(data, [70, 120])
    got = run(feed(spark, str(tmp_path / "in"), [*parts[:2], parts[2] + late]), tmp_path, spark)
    aside = [g for g in got if g[-1] == keyed.LATE]
    assert sorted(aside, key=str) == sorted([(u, None, None, at, None, None, keyed.LATE) for u, at, _, _ in late], key=str)
    rest = [g for g in got if g[-1] != keyed.LATE]
    assert len(rest) == len(set(rest)) and set(rest) == in_batch(spark, data, ["u"])


class Plan:
    """Stands for a stream and takes the function that is run on each group."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    groupBy = select

    def applyInPandasWithState(self, update, *schemas):
        return update


class Held:
    exists, get = False, None

    def update(self, values):
        self.exists, self.get = True, values


def test_windows_of_many_keys_are_few_tables(spark):
    """Before, each window of each key was a table of its own, and each key a call."""
    import pandas as pd

    update = keyed.stream_outliers_keyed(Plan(spark.createDataFrame([], "u int, at bigint, v double, t string").schema), "u", ["at"], ATTRS, SPEC, PARAMS, ["at"])
    r, state, found = random.Random(2), Held(), []
    for batch in range(2):
        points = [(u, batch * 1000 + i, r.random() * 9, r.choice("ab")) for u in range(50) for i in range(40)]
        found.append(list(update((0, False), iter([pd.DataFrame(points, columns=["u", "at", "v", "t"])]), state)))
    assert [len(tables) for tables in found] == [1, 1]
    assert [len(tables[0]) for tables in found] == [50 * 8 * SPEC.width, 50 * 10 * SPEC.width]
    assert state.get[1] == [80] * 50 and all(8 <= n <= SPEC.width for n in state.get[2])
