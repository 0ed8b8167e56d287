"""Repeated lines against a plain dictionary of lines."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from farpoint.llm import line_dedup
from farpoint.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                holders[key(line)].add(doc)
    found = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stays = lambda line: doc is None or len(holders.get(key(line), ())) < 2 or min(holders[key(line)]) == doc
        kept = [line for line in lines if stays(line)]
        found.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(found, key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    result = con.execute(ORACLES["op7_line_dedup"])
    names = [c[0] for c in result.description]
    got = QUERIES["op7_line_dedup"](spark, FOLDER).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall()) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize(("shard_keys", "probe_rows"), [(65_536, 1_000_000), (2, 3)])
def test_edge_rows(spark, shard_keys, probe_rows):
    shared = "A line that several hold"
    long = "\n".join([shared, " \v" + shared.upper() + "\f", "short", "own " * 40_000])
    rows = [(4, shared), (2, f"x\n{shared}\n{shared}"), (9, long), (3, None), (5, ""), (6, "\n\n"), (None, shared), (7, "short\n\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4!"), (8, "\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4\u00c4!"), (2, shared), (10, shared), (11, "unique enough line")]
    rows += [(100 + i, f"{shared}\ncommon text number {i % 7}") for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _lines int")
    df = df.withColumnRenamed("_lines", "high")
    got = line_dedup.dedup_lines(df, shard_keys=shard_keys, probe_rows=probe_rows)
    assert got.columns == ["doc_id", "text", "high", "_lines", "_dropped"]
    assert sorted((tuple(r) for r in got.drop("high").collect()), key=str) == plain(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_perfect_hash():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 20_000):
        high, low = draw.integers(0, 2**63, size=(2, n), dtype=np.uint64)
        table = line_dedup.PerfectHash.from_bytes(*line_dedup.PerfectHash.build(high, low).to_bytes())
        assert sorted(table.slots(high, low).tolist()) == list(range(n))
    assert hashlib.sha256(b"").hexdigest()
