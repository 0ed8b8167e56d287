"""Repairs against a plain search from the end of a conversation, block by block and whole."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from farpoint.llm import repair
from farpoint.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, block int, seq string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
SEEN = "".join(chr(c) for c in (32, 9, 10, 11, 12, 13))


def plain(rows):
    """(turn, role, text) of one conversation -> result columns."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, earlier = [], set()
    for _, role, text in rows:
        seen = text.strip(SEEN)
        faults.append("blank" if not seen else "duplicate" if (role, text) in earlier else "" if seen[-1] in ".!?" else "truncated")
        earlier.add((role, text))

    @lru_cache(None)
    def best(i, last, inserted):
        options = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if inserted < 2:
            for r in set("ua") & set(NEXT[last]):
                options.append((2, "I", i, r, inserted + 1))
        if i < len(rows):
            options.append((3, "D", i + 1, last, 0))
            if faults[i] in ("", "truncated"):
                extra = faults[i] == "truncated"
                if rows[i][1][:1] and rows[i][1][:1] in NEXT[last]:
                    options.append((extra, "K", i + 1, rows[i][1][:1], 0))
                for r in set("ua") & set(NEXT[last]):
                    options.append((2 + extra, "R", i + 1, r, 0))
        found = []
        for cost, edit, *rest in options:
            more = best(*rest) if rest else (0, "")
            if more is not None:
                found.append((cost + more[0], edit + more[1]))
        return min(found, default=None)

    for i in range(len(rows), 0, -50):  # from the end, to keep the recursion flat
        for last in NEXT:
            best(i, last, 0)
    cost, audit = best(0, "", 0)
    out, i, last = [], 0, ""
    for edit in audit:
        if edit == "I":
            last = NEXT[last][-1]
            out.append(("user" if last == "u" else "assistant") + ":")
            continue
        _, role, text = rows[i]
        i += 1
        if edit == "D":
            continue
        if edit == "R":
            role = "user" if NEXT[last][-1] == "u" else "assistant"
        last = role[:1]
        out.append(f"{role}:{text}")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    kinds = Counter(faults)
    return gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def by_conversation(rows):
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(tuple(rest[:3]))
    return {(conv, *plain(some)) for conv, some in groups.items()}


def some_rows(n, seed, convs):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "u"]
    texts = ["Yes.", "No!", "why?", "cut off", "", None, " \t", "same.", "é.  "]
    turn = lambda: r.choice([None, r.randint(-2, 30), r.randint(0, 12)])
    return [(r.choice([None, *range(convs)]), turn(), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"t{r.random()}.", 1, "x") for _ in range(n)]


@pytest.mark.parametrize("block_rows", [1, 2, 5, 512])
def test_repairs(spark, block_rows):
    rows = some_rows(500, 1, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in repair.repair_conversations(df, block_rows=block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == by_conversation(rows)


def test_one_long_conversation(spark):
    rows = some_rows(1500, 2, 1)[:1500] + [(7, i, "user" if i % 3 else "assistant", "x" * (200_000 if i == 700 else 3) + "." * (i % 5), 1, "x") for i in range(1300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in repair.repair_conversations(df, block_rows=100).collect()} == by_conversation(rows)


def test_least_audit_of_equal_costs():
    assert repair.lightest([("a", False, False)], repair.NONE, True) == {repair.GOAL: (2, "IK")}
    assert repair.lightest([("u", False, False)], repair.NONE, True) == {repair.GOAL: (2, "KI")}
    assert repair.lightest([("x", False, False)], repair.NONE, True) == {repair.GOAL: (3, "D")}
    assert repair.lightest([], repair.NONE, True) == {repair.GOAL: (0, "")}


def test_empty_table(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    there = by_conversation(damaged(rows))
    return there | {(c, *nothing) for c in {r[0] for r in rows} - {r[0] for r in there}}


def test_damage_and_lost_conversations(spark):
    rows = some_rows(400, 3, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in repair.with_all_conversations(repair.repair_conversations(repair.damage(df)), df).collect()}
    assert got == expected(rows)


def test_query(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_conversation_repair"](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows)
