"""Rendered perspectives against SQL, and against plain rendering of odd rows."""

import duckdb
from collections import Counter

from farpoint.llm import perspectives
from farpoint.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    result = con.execute(ORACLES["op10_chat_perspectives"])
    names = [c[0] for c in result.description]
    got = QUERIES["op10_chat_perspectives"](spark, FOLDER)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    text = lambda rows: Counter(str(tuple(r)) for r in rows)
    assert text(got.select(*names).collect()) == text(result.fetchall())


def test_edge_rows(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "anna", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "carl\n|>", "x"), (1, 3, "anna", "y"), (1, None, None, ""), (2, 0, "system", "alone"), (None, 5, "bob", "z"), (1, 1, "anna", "hi <|end|>")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {(r.conv_id, r.assistant): r for r in perspectives.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "anna"), (1, "bob"), (1, "carl\n|>"), (1, "unknown"), (None, "bob")}
    anna = got[1, "anna"]
    end = "<|end|>\n"
    assert anna.rendered == (
        f"<|user name=unknown|>\n{end}<|system|>\nrules{end}" + f"<|assistant|>\nhi <||end|>{end}" * 2
        + f"<|user name=bob|>\n{end}<|assistant|>\ny{end}<|user name=carl   |>\nx{end}"
    )
    own = [anna.rendered[a:b] for a, b in zip(anna.mask_starts, anna.mask_ends)]
    assert own == [f"hi <||end|>{end}"] * 2 + [f"y{end}"] and anna.n_messages == 7
    assert perspectives.rotate_perspectives(df.limit(0)).count() == 0


def test_long_dialogues_go_on_in_parts(spark):
    rows = [(7, i, "ab"[i % 2], f"message {i} " * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.assistant: r for r in perspectives.rotate_perspectives(df).collect()}
    parts = perspectives.rotate_perspectives(df, part_chars=500).collect()
    for name, one in whole.items():
        mine = sorted((r for r in parts if r.assistant == name), key=lambda r: r.part)
        assert len(mine) > 5 and "".join(r.rendered for r in mine) == one.rendered and all(len(r.rendered) < 700 for r in mine)
        spans = [r.rendered[a:b] for r in mine for a, b in zip(r.mask_starts, r.mask_ends)]
        assert spans == [one.rendered[a:b] for a, b in zip(one.mask_starts, one.mask_ends)] and len(spans) == 150
