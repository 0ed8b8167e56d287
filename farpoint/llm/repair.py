"""Least-cost repair of conversations by Knuth's lightest derivation.

An item says that the first rows of a conversation have been edited and which role came last. Edits of rows are the axioms; a rule
combines an item with an edit (keep, give a role, delete) of the next row, or with an insertion, to a further item. Its
weight is (cost, audit): costs add up and audits are joined, so it is never lighter than the item it came from, and keeps the order of
two derivations of one item, as neither audit then begins with the other. Items therefore leave the agenda in order
of weight, each first with its lightest derivation, until the goal item does.

A conversation may hold any share of all rows. Rows are numbered across tasks and cut into blocks; a block is repaired for
each role that may have come before it, and only costs and the order of its audits go to the one task that chooses a path
through the blocks of a conversation. Texts of long conversations are repaired block by block; the digest of one repaired
conversation is then made by one task, which reads its blocks as a stream.

NULL roles and texts count as one space; NULL turns come first; rows of one turn are ordered by role and text.
NULL is a conversation of its own. Texts may be empty or of any length. An empty table gives an empty result.
Columns other than the four named ones are left out, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from farpoint.operators.numbering import number_rows
from farpoint.session import materialize

BLOCK_ROWS = 512
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

# Last role so far: none, system, user, assistant; what each initial leads to; where a conversation may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (NONE, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
GOAL = -1

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def lightest(rows: list[tuple[str, bool, bool]], before: int, last: bool) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from the role ``before`` to each role after the rows, or to the goal if these are the ``last``.

    A row is its initial, whether it must go, and whether it is truncated. Insertions come right before a row; only
    after the last rows can they stand at the end.
    """
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, before)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, at, role = heapq.heappop(agenda)
        if (at, role) in done:
            continue
        done.add((at, role))
        if role == GOAL:
            return {GOAL: (cost, audit)}
        if at == len(rows):
            if not last:
                found[role] = (cost, audit)
                continue
            if role in FINAL:
                heapq.heappush(agenda, (cost, audit, at, GOAL))
        else:
            initial, must_go, truncated = rows[at]
            heapq.heappush(agenda, (cost + DELETE, audit + "D", at + 1, role))
            if not must_go:
                cut = TRUNCATED if truncated else 0
                if (role, initial) in STEP:
                    heapq.heappush(agenda, (cost + KEEP + cut, audit + "K", at + 1, STEP[role, initial]))
                for new in ROLES:
                    if (role, new) in STEP:
                        heapq.heappush(agenda, (cost + REROLE + cut, audit + "R", at + 1, STEP[role, new]))
        for new in ROLES:
            if (role, new) in STEP:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", at, STEP[role, new]))
    return found


def repaired(rows: list[tuple[str, str]], audit: str, before: int) -> str | None:
    """The repaired rows (role, text) as lines, or None if there are none."""
    lines, at, last = [], 0, before
    for edit in audit:
        role, text = rows[at] if edit != "I" else ("", "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit in "RI":
            role = ROLES["a" if last == USER else "u"]
        last = STEP[last, role[:1]]
        lines.append(f"{role}:{text}")
    return "\n".join(lines) if lines else None


def _digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with the same first ``keys`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _illegal(left: str, right: str) -> bool:
    return left[:1] + right[:1] not in ("su", "ua", "au")


def _block(rows: list[tuple], block: int, blocks: int) -> dict:
    """Faults of a block, the lightest derivations through it, and the result if the conversation ends with it."""
    shown, judged, counts = [], [], dict.fromkeys(COUNTS[1:], 0)
    first = False
    for _, is_row, turn, role, text in rows:
        if not is_row:
            first = True
            continue
        seen = text.rstrip(WHITE)
        fault = "blank" if not seen else "duplicate" if not first else "truncated" if seen[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        if shown:
            counts["illegal"] += _illegal(shown[-1][0], role)
        shown.append((role, text))
        judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        first = False
    turns = [r[2] for r in rows if r[1]]
    known = [t for t in turns if t is not None]
    last = block == blocks - 1
    paths = {b: lightest(judged, b, last) for b in ((NONE,) if blocks == 1 else range(4))}
    # Costs by role before and after, and places of the audits in order among those with the same role before.
    costs, order, audits = [], [], []
    for b in range(4):
        ends = paths.get(b, {})
        ranked = sorted(a for _, a in ends.values())
        for after in (GOAL, *range(4)):
            cost, audit = ends.get(after, (None, None))
            costs.append(cost)
            order.append(None if audit is None else ranked.index(audit))
            audits.append(audit)
    out = {
        **counts, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
        "first_turn": turns[0], "last_turn": turns[-1], "first_role": shown[0][0][:1], "last_role": shown[-1][0][:1],
        "costs": costs, "order": order, "audits": audits, "gaps": None, "cost": None, "audit": None, "repaired_sha256": None,
    }
    if blocks == 1:
        out["cost"], out["audit"] = paths[NONE][GOAL]
        out["repaired_sha256"] = _digest(repaired(shown, out["audit"], NONE))
        out["gaps"] = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return out


_BLOCK_FIELDS = (
    [(c, "long") for c in (*COUNTS, "low", "high", "turns", "first_turn", "last_turn")]
    + [("first_role", "string"), ("last_role", "string"), ("costs", "array<long>"), ("order", "array<long>"), ("audits", "array<string>")]
    + [("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
)
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batches(rows: Iterator[dict], conv: pa.DataType, fields: list[tuple[str, str]], size: int = 2000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", conv)] + [(n, _ARROW[t]) for n, t in fields])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _map(df: DataFrame, keys: int, work, fields: list[tuple[str, str]]) -> DataFrame:
    """``work`` on each group of rows of the sorted partitions, which gives the rows of ``fields`` after ``conv``."""
    conv = df.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def all_batches():
            yield first
            yield from batches

        yield from _batches(({"conv": key[0], **row} for key, rows in _groups(all_batches(), keys) for row in work(key, rows)), first.schema.field(0).type, fields)

    return df.mapInArrow(run, f"conv {conv}, " + ", ".join(f"`{n}` {t}" for n, t in fields))


_CHOICE = [("block", "long"), ("before", "long"), ("after", "long"), *[(c, "long") for c in COUNTS], ("cost", "long")]


def _choose(key: tuple, blocks: list[tuple]) -> Iterator[dict]:
    """The lightest path through the blocks of a conversation, which come last block first, and its totals."""
    costs: list[int | None] = [0] * 4
    choices, totals, distinct, low, high, next_block = [], [0] * 4, 0, None, None, None
    for block, *counts, least, most, turns, first_turn, last_turn, first_role, last_role, through, order in blocks:
        totals = [x + y for x, y in zip(totals, counts)]
        distinct += turns
        if next_block:
            distinct -= last_turn is not None and last_turn == next_block[0]
            totals[3] += _illegal(last_role, next_block[1])
        low = least if low is None else low if least is None else min(low, least)
        high = most if high is None else high if most is None else max(high, most)
        next_block = first_turn, first_role
        best, taken = [], []
        for before in range(4):
            options = []
            for place, after in enumerate((GOAL, *range(4))):
                cost = through[before * 5 + place]
                rest = 0 if after == GOAL else costs[after]
                if cost is not None and rest is not None:
                    options.append((cost + rest, order[before * 5 + place], after))
            least_option = min(options)
            best.append(least_option[0])
            taken.append(least_option[2])
        costs = best
        choices.append(taken)
    before = NONE
    for number, taken in enumerate(reversed(choices)):
        row = {"block": number, "before": before, "after": taken[before]}
        if number == 0:
            gaps = high - low + 1 - distinct if low is not None else 0
            row |= {**dict(zip(COUNTS, [gaps, *totals])), "cost": costs[NONE]}
        yield row
        before = taken[before]


def _repair_block(key: tuple, rows: list[tuple]) -> Iterator[dict]:
    """The repaired text of a block; its first row holds what was chosen."""
    *_, before, audit, totals = rows[0]
    text = repaired([(role, text) for _, role, text, *_ in rows[1:]], audit, before)
    yield {"block": key[1], "audit": audit, "text": text, "totals": totals}


def _join_blocks(key: tuple, blocks: Iterator[tuple]) -> dict:
    digest, audits, totals, begun = hashlib.sha256(), [], None, False
    for _, audit, text, here in blocks:
        totals = here or totals
        audits.append(audit)
        if text is not None:
            digest.update((b"\n" if begun else b"") + text.encode())
            begun = True
    return {"conv": key[0], **dict(zip([*COUNTS, "cost"], totals)), "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}


_RESULT = [*[(c, "long") for c in (*COUNTS, "cost")], ("audit", "string"), ("repaired_sha256", "string")]


def _stream_blocks(df: DataFrame) -> DataFrame:
    """One row per conversation from its repaired blocks, read one after the other."""
    conv = df.schema[0].dataType.simpleString()
    schema = pa.schema([("conv", to_arrow_type(df.schema[0].dataType))] + [(n, _ARROW[t]) for n, t in _RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    yield from zip(*(c.to_pylist() for c in batch.slice(start, 64).columns))

        source = rows()
        row = next(source, None)
        while row is not None:
            key, rest = row[:1], None

            def one(row=row):
                nonlocal rest
                while row is not None and row[:1] == key:
                    yield row[1:]
                    row = next(source, None)
                rest = row

            result = _join_blocks(key, one())
            yield pa.RecordBatch.from_pylist([result], schema=schema)
            row = rest

    return df.mapInArrow(run, f"conv {conv}, " + ", ".join(f"{n} {t}" for n, t in _RESULT))


def repair_conversations(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Faults, least repair cost, audit and digest of the repaired rows, per conversation.

    Roles of a repaired conversation are an optional system row and then user and assistant in turns. Blank and repeated rows
    must go; truncated rows that stay cost extra. Of repairs with equal costs that with the least audit is taken.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text")
    )
    numbered = number_rows(rows, ["turn", "role", "text"], ["conv"], "seq", "total").withColumn("block", F.expr(f"(seq - 1) div {block_rows}"))
    blocks = F.expr(f"(total - 1) div {block_rows} + 1").alias("blocks")
    firsts = numbered.groupBy("conv", "role", F.sha2("text", 256).alias("_sha")).agg(F.min("seq").alias("seq"), F.first("total").alias("total"))
    nothing = F.lit(None)
    marks = firsts.select(
        "conv", F.expr(f"(seq - 1) div {block_rows}").alias("block"), blocks, "seq", F.lit(False).alias("is_row"),
        nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"),
    )
    # The first row of each role and text follows a mark.
    dealt = numbered.select("conv", "block", blocks, "seq", F.lit(True).alias("is_row"), "turn", "role", "text").unionByName(marks)
    dealt = dealt.repartition("conv", "block").sortWithinPartitions("conv", "block", "seq", "is_row")
    in_blocks = materialize(
        _map(dealt, 3, lambda key, held: [{"block": key[1], "blocks": key[2], **_block(held, key[1], key[2])}], [("block", "long"), ("blocks", "long"), *_BLOCK_FIELDS]),
        "blocks",
    )
    short = in_blocks.where("blocks = 1").select("conv", *[n for n, _ in _RESULT])

    long = in_blocks.where("blocks > 1")
    narrow = ["block", *COUNTS[1:], "low", "high", "turns", "first_turn", "last_turn", "first_role", "last_role", "costs", "order"]
    paths = long.select("conv", *narrow).repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    chosen = _map(paths, 1, _choose, _CHOICE)
    place = F.col("before") * 5 + F.col("after") + 2
    audits = long.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "audits")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    totals = F.when(F.col("cost").isNotNull(), F.array(*COUNTS, "cost"))
    heads = chosen.join(audits, same).select(
        "conv", "block", F.lit(0).cast("long").alias("seq"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"),
        "before", F.element_at("audits", place.cast("int")).alias("audit"), totals.alias("totals"),
    )
    empty = {"before": nothing.cast("long"), "audit": nothing.cast("string"), "totals": nothing.cast("array<long>")}
    texts = numbered.where(F.col("total") > block_rows).select("conv", "block", "seq", "role", "text").withColumns(empty)
    again = heads.unionByName(texts).repartition("conv", "block").sortWithinPartitions("conv", "block", "seq")
    fixed = _map(again, 2, _repair_block, [("block", "long"), ("audit", "string"), ("text", "string"), ("totals", "array<long>")])
    whole = _stream_blocks(fixed.repartition("conv").sortWithinPartitions("conv", "block"))
    result = short.unionByName(whole)
    return result.withColumnRenamed("conv", conv) if conv != "conv" else result


# Damage for trials ---------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn: some dropped, emptied, unpunctuated, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy"))
    return rows.drop("_copy")


def with_all_conversations(repairs: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Also the conversations of which no row is left: nothing to count, nothing to repair."""
    ids = conversations.select(F.col(f"`{conv}`").alias("_id")).distinct()
    joined = ids.join(repairs, F.col("_id").eqNullSafe(F.col(conv)), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")]
    return joined.select(
        F.col("_id").alias(conv), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_digest(None))).alias("repaired_sha256"),
    )
