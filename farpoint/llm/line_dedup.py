"""Repeated lines across documents, found by probing sharded minimal perfect hash tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.arrow import map_texts, small_batches, texts
from farpoint.session import materialize

WHITE = b" \t\n\v\f\r"
# A line shorter than this many code points is never repeated.
MIN_CHARS = 10
# Line keys of one hash table, about 1.5 MB.
SHARD_KEYS = 65_536
# Probes that one task answers from one copy of a table; tables with more are copied.
PROBE_ROWS = 1_000_000
# Slots per key and level of a table.
GAMMA = 2


def line_keys(raw: bytes, min_chars: int = MIN_CHARS) -> list[tuple[int, int] | None]:
    """For each line of a text the 128-bit hash of its key, None if the key is short.

    Lines are split at \\n (an empty text is one empty line). The key is the line without ASCII white
    space at both ends and with A-Z in lower case; its length is counted in code points.
    """
    found: list[tuple[int, int] | None] = []
    for line in raw.split(b"\n"):
        key = line.strip(WHITE).lower()
        chars = len(key) if key.isascii() else len(key.decode("utf-8", "replace"))
        if chars < min_chars:
            found.append(None)
        else:
            value = xxhash.xxh3_128_intdigest(key)
            found.append((_signed(value & _LOW), _signed(value >> 64)))
    return found


_LOW = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _place(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    h = high ^ (low * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD6E8FEB86659FD93 & _LOW)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: bit arrays by level, slots by rank.

    A key sits in the first level where it is alone in its cell; its slot is the number of set bits
    before. Keys outside the set get some slot or -1, so a fingerprint has to confirm them.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.cumsum([0, *[int(bits.sum()) for bits in levels]])
        self.ranks = [np.cumsum(bits) - 1 for bits in levels]

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high):
            cells = _place(high, low, len(levels)) % np.uint64(GAMMA * len(high) + 1)
            counts = np.bincount(cells.astype(np.int64), minlength=GAMMA * len(high) + 1)
            levels.append(counts == 1)
            clash = counts[cells] != 1
            high, low = high[clash], low[clash]
        return cls(levels)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found = np.full(len(high), -1, dtype=np.int64)
        left = np.arange(len(high))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            cells = (_place(high[left], low[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[cells]
            found[left[hit]] = self.starts[level] + self.ranks[level][cells[hit]]
            left = left[~hit]
        return found

    def to_bytes(self) -> tuple[bytes, list[int]]:
        sizes = [len(bits) for bits in self.levels]
        return np.packbits(np.concatenate(self.levels) if sizes else np.zeros(0, bool)).tobytes(), sizes

    @classmethod
    def from_bytes(cls, packed: bytes, sizes: list[int]) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=int(sum(sizes))).astype(bool)
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])


def _print(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))


TABLE = "shard int, part int, cells binary, sizes array<int>, prints binary, counts binary, owners binary"


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    high, low = pdf["high"].to_numpy().view(np.uint64), pdf["low"].to_numpy().view(np.uint64)
    table = PerfectHash.build(high, low)
    order = np.empty(len(high), dtype=np.int64)
    order[table.slots(high, low)] = np.arange(len(high))
    cells, sizes = table.to_bytes()
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "cells": [cells],
            "sizes": [sizes],
            "prints": [_print(high, low)[order].tobytes()],
            "counts": [pdf["documents"].to_numpy()[order].tobytes()],
            "owners": [pdf["owner"].to_numpy()[order].tobytes()],
        }
    )


def keys_of_documents(docs: DataFrame, id_column: str, text: str, min_chars: int) -> DataFrame:
    """Distinct line keys (``high``, ``low``) of each row with an id."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, high, low = [], [], []
        for doc, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            keys = {k for k in line_keys(raw, min_chars) if k}
            ids.extend([doc] * len(keys))
            high.extend(k[1] for k in keys)
            low.extend(k[0] for k in keys)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, high, low)], names=["_id", "high", "low"])

    named = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("_id"), F.col(f"`{text}`")).where("_id IS NOT NULL")
    return map_texts(named, work, "_id bigint, high bigint, low bigint")


def repeated_keys(docs: DataFrame, id_column: str, text: str, min_chars: int, shard_keys: int, probe_rows: int) -> DataFrame:
    """Per document the line keys that it loses: those of two or more documents whose smallest id is another.

    Keys are counted by hash with partial sums. Those of at least two documents go into shards of about
    ``shard_keys`` keys, each with a minimal perfect hash and arrays of fingerprints, document
    counts and owners. The keys of all documents then stream past the arrays of their shard, which
    is copied where it has many probes, so no line is joined and a frequent line is no hot group.
    """
    keys = materialize(keys_of_documents(docs, id_column, text, min_chars), "line_keys")
    counted = keys.groupBy("high", "low").agg(
        F.min("_id").alias("owner"), F.max("_id").alias("_last"), F.count("*").alias("documents")
    )
    repeated = materialize(counted.where("owner < _last").drop("_last"), "repeated_lines")
    shards = max(1, -(-repeated.count() // shard_keys))
    shard = F.pmod("high", F.lit(shards)).cast("int").alias("shard")
    probes = keys.select(shard, "*")
    parts = materialize(probes.groupBy("shard").agg(F.ceil(F.count("*") / probe_rows).cast("int").alias("parts")), "probe_parts")
    schema = TABLE.replace("part int, ", "")
    tables = repeated.select(shard, "*").groupBy("shard").applyInPandas(_build_shard, schema)
    tables = tables.join(parts, "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    places = probes.join(parts, "shard").select("*", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int").alias("part"))
    stored = [c.split(" ")[0] for c in TABLE.split(", ")]
    both = tables.select(*stored).unionByName(places.select("shard", "part", "_id", "high", "low"), allowMissingColumns=True)
    both = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("cells").isNull())
    return both.mapInArrow(_probe, "_id bigint, high bigint, low bigint")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each document that another document owns; a shard's table comes before its probes."""
    at, table, prints, counts, owners = None, None, None, None, None
    for batch in batches:
        for part in small_batches([batch], 8192):
            shard, cells = part.column("shard").to_numpy(), part.column("cells")
            is_table = cells.is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(is_table)
            runs = [0, *starts.tolist(), part.num_rows]
            for begin, end in zip(runs, runs[1:]):
                if begin == end:
                    continue
                if is_table[begin]:
                    value = lambda name: part.column(name)[begin].as_py()  # noqa: B023
                    at = shard[begin]
                    table = PerfectHash.from_bytes(value("cells"), value("sizes"))
                    prints = np.frombuffer(value("prints"), dtype=np.uint64)
                    counts = np.frombuffer(value("counts"), dtype=np.int64)
                    owners = np.frombuffer(value("owners"), dtype=np.int64)
                    begin += 1
                rows = part.slice(begin, end - begin)
                if at is None or not rows.num_rows:
                    continue
                rows = rows.filter(pa.array(shard[begin:end] == at))
                if not rows.num_rows:
                    continue
                ids, high, low = (rows.column(c).to_numpy() for c in ("_id", "high", "low"))
                h, k = high.view(np.uint64), low.view(np.uint64)
                slots = table.slots(h, k)
                known = slots >= 0
                known[known] = prints[slots[known]] == _print(h[known], k[known])
                known[known] = (counts[slots[known]] > 1) & (owners[slots[known]] != ids[known])
                yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in (ids, high, low)], names=["_id", "high", "low"])


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    shard_keys: int = SHARD_KEYS,
    probe_rows: int = PROBE_ROWS,
) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, ``_lines`` before and ``_dropped`` lines.

    A line key of ``min_chars`` code points or more that two or more documents hold stays only in
    the smallest id that holds it, there as often as it occurs. Other lines stay, in order, joined by
    \\n. NULL text counts as one empty line and becomes the empty text. Rows without an id keep all
    lines and count for no other row. Rows that share an id are one document. Other columns pass through, whatever their
    names. An empty table gives an empty table.
    """
    lost = repeated_keys(docs, id_column, text, min_chars, shard_keys, probe_rows)
    lost = lost.groupBy("_id").agg(F.collect_set(F.struct("high", "low")).alias("_lost"))
    names = docs.columns
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_column}`").cast("bigint").alias("_id")
    )
    joined = held.join(lost, "_id", "left").select(
        F.col(f"_row.`{text}`").alias("_text"), "_row", F.col("_lost.high").alias("_high"), F.col("_lost.low").alias("_low")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, lines, dropped = [], [], []
        for raw, high, low in zip(texts(batch.column(0)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            parts = raw.split(b"\n")
            lines.append(len(parts))
            if high:
                gone = set(zip(low, high))
                parts = [p for p, k in zip(parts, line_keys(raw, min_chars)) if k not in gone]
            kept.append(b"\n".join(parts))
            dropped.append(lines[-1] - len(parts))
        columns = [batch.column(1), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["_row", "_kept", "_lines", "_dropped"])

    row = held.schema["_row"].dataType.simpleString()
    done = map_texts(joined, work, f"_row {row}, _kept string, _lines bigint, _dropped bigint")
    columns = [F.col("_kept").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names]
    return done.select(*columns, "_lines", "_dropped")
