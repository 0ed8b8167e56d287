import random

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from farpoint import Attr, OutlierParams
from farpoint.operators.evidence import status_timeline
from farpoint.streaming.changes import Window, _Changes


class State:
    def __init__(self):
        self.held = {}

    def get(self):
        return self.held.get(None)

    def update(self, value):
        self.held[None] = value

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]

    def exists(self):
        return None in self.held


def test_changes_of_a_key_come_in_few_tables(spark):
    r = random.Random(9)
    rows = [(1, i, float(r.randint(0, 9))) for i in range(3_000)]
    attrs, width, params = [Attr("v")], 12, OutlierParams(1.0, 2)
    types = {"u": T.LongType(), "at": T.LongType(), "v": T.DoubleType()}
    processor = _Changes("u", ["at"], attrs, width, params, types, None)
    processor.head, processor.points, processor.counts = State(), State(), State()
    tables = []
    for part in (rows[:1_700], rows[1_700:]):
        tables += list(processor.handleInputRows(("=1",), iter([pd.DataFrame(part, columns=["u", "at", "v"])]), None))
    assert len(tables) <= 6
    numbered = spark.createDataFrame([(i + 1, len(rows), v) for _, i, v in rows], "seq bigint, stream_rows bigint, v double")
    wanted = {tuple(x) for x in status_timeline(numbered, width, attrs, params).collect()}
    got = [tuple(x) for x in pd.concat(tables).drop(columns="u").itertuples(index=False)]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_a_run_may_be_longer_than_the_window():
    r = random.Random(10)
    values = [float(r.randint(0, 6)) for _ in range(200)]
    def changes(run):
        window, got = Window([Attr("v")], 5, OutlierParams(1.0, 2), 1, {"v": np.zeros(0)}, [], []), []
        for start in range(0, len(values), run):
            got += list(zip(*window.advance({"v": np.array(values[start : start + run])}).values()))
        return sorted(got)

    assert changes(1) == changes(5) == changes(64) == changes(200)
