"""Packing documents into sequences of bounded length: best fit, then swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.arrow import map_texts, texts
from farpoint.llm.tokens import encoder, tokenizer_path
from farpoint.session import materialize

CAPACITY = 4096
END_ID = 1
# Pieces that one task packs.
GROUP_PIECES = 20_000
# A bin below this share of the capacity is packed anew together with those of other tasks.
FULL_ENOUGH = 0.98
# Items of a bin that two-for-one exchanges pair up; longer bins use their largest items.
PAIRED = 64

PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def document_pieces(
    docs: DataFrame, id_column: str, text: str, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """Pieces of each document's token ids (its text's ids, then the end id), cut only above ``capacity``.

    NULL text counts as empty, which leaves the end id alone. ``ids`` is added on request.
    """
    path = path or tokenizer_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = encoder(path)
        source, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, raw in enumerate(texts(batch.column(1))):
            ids = np.append(tokens.ids(raw), np.array([END_ID], dtype="<u4")).astype("<u4")
            for number, begin in enumerate(range(0, len(ids), capacity)):
                own = ids[begin : begin + capacity]
                source.append(i)
                piece.append(number)
                start.append(begin)
                length.append(len(own))
                crc.append(zlib.crc32(own.tobytes()))
                kept.append(own.tolist() if keep_ids else None)
        ints = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        columns = [batch.column(0).take(pa.array(source, pa.int64())), *ints]
        names = [id_column, "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            columns, names = [*columns, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_column}` {dict(docs.dtypes)[id_column]}, {PIECE}" + ", ids array<bigint>" * keep_ids
    return map_texts(docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")), work, schema)


class Bins:
    """Bins of item numbers under local search on the sum of squared fills."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.sizes, self.capacity = lengths, np.array(lengths, dtype=np.int64), capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self._best_fit_decreasing()

    def _best_fit_decreasing(self) -> None:
        spaces: list[tuple[int, int]] = []
        for item in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            size = self.lengths[item]
            at = bisect_left(spaces, (size, -1))
            if at < len(spaces):
                space, number = spaces.pop(at)
            else:
                space, number = self.capacity, len(self.items)
                self.items.append([])
                self.free.append(self.capacity)
            self.items[number].append(item)
            self.free[number] = space - size
            if space > size:
                insort(spaces, (space - size, number))

    def _shift(self, source: int, target: int, out: list[int], back: list[int]) -> None:
        """Items ``out`` go from source to target, items ``back`` the other way."""
        for a, b, moved in ((source, target, out), (target, source, back)):
            for item in moved:
                self.items[a].remove(item)
                self.items[b].append(item)
                self.free[a] += self.lengths[item]
                self.free[b] -= self.lengths[item]

    def _better(self, source: int, target: int) -> tuple[list[int], list[int]] | None:
        """The change that fills ``target`` most: a move, one for one, or two for one.

        The source is not fuller than the target, so filling the target raises the sum of squares.
        """
        space = self.free[target]
        own, theirs = np.array(self.items[source]), np.array(self.items[target])
        size, other = self.sizes[own], self.sizes[theirs]
        best, change = 0, None
        for gain, pick in (
            (size, lambda k: ([int(own[k])], [])),
            ((size[:, None] - other[None, :]).ravel(), lambda k: ([int(own[k // len(theirs)])], [int(theirs[k % len(theirs)])])),
        ):
            fits = np.where((gain > best) & (gain <= space), gain, 0)
            k = int(fits.argmax()) if len(fits) else 0
            if len(fits) and fits[k] > best:
                best, change = int(fits[k]), pick(k)
        if best < space and len(own) > 1:
            large = np.argsort(-size)[:PAIRED]
            a, b = np.triu_indices(len(large), 1)
            sums = size[large[a]] + size[large[b]]
            gain = (sums[:, None] - other[None, :]).ravel()
            fits = np.where((gain > best) & (gain <= space), gain, 0)
            k = int(fits.argmax())
            if fits[k] > best:
                pair, one = divmod(k, len(theirs))
                change = ([int(own[large[a[pair]]]), int(own[large[b[pair]]])], [int(theirs[one])])
        return change

    def improve(self) -> None:
        """Empty the least filled bins into the others, until the bound is met or no change helps."""
        bound = -(-sum(self.lengths) // self.capacity)
        alive = {b for b in range(len(self.items)) if self.items[b]}
        while len(alive) > bound:
            source = max(alive, key=lambda b: (self.free[b], b))
            changed = False
            for target in sorted((b for b in alive if self.free[b] and b != source), key=lambda b: (self.free[b], b), reverse=True):
                while self.items[source] and self.free[source] >= self.free[target] > 0:
                    change = self._better(source, target)
                    if change is None:
                        break
                    self._shift(source, target, *change)
                    changed = True
                if not self.items[source]:
                    break
            if not self.items[source]:
                alive.discard(source)
            elif not changed:
                break

    def placed(self) -> list[tuple[int, int, int]]:
        """(item, bin, offset) of every item."""
        found = []
        for number, items in enumerate(self.items):
            offset = 0
            for item in items:
                found.append((item, number, offset))
                offset += self.lengths[item]
        return found


def _pack_group(capacity: int, level: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        bins = Bins(pdf["length"].tolist(), capacity)
        bins.improve()
        item, number, offset = (np.array(x, dtype=np.int64) for x in zip(*bins.placed()))
        fill = capacity - np.array(bins.free, dtype=np.int64)
        return pd.DataFrame(
            {
                "row": pdf["row"].to_numpy()[item],
                "length": pdf["length"].to_numpy()[item],
                "level": np.int32(level),
                "pack": pdf["pack"].to_numpy()[item],
                "bin": number,
                "offset": offset,
                "fill": fill[number],
            }
        )

    return pack


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    path: str | None = None,
    group_pieces: int = GROUP_PIECES,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    Whole pieces of ``capacity`` ids are sequences of their own. The others are dealt by hash into
    groups of about ``group_pieces``; a task packs its group by best fit and then by local search. Bins
    that stay clearly underfull are packed anew together with those of other groups, level by level, until one
    group holds what is left, so the number of sequences does not depend much on the number of tasks. NULL text is the empty
    text; rows without an id and repeated rows are packed like any other; an empty table gives an
    empty table. Other columns of ``docs`` are not read.
    """
    pieces = document_pieces(docs, id_column, text, capacity, path, keep_ids)
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    left = pieces.where(F.col("length") < capacity).select(F.col("_row").alias("row"), "length")
    schema = "row bigint, length bigint, level int, pack int, bin bigint, offset bigint, fill bigint"
    placed, level = [], 0
    count = left.count()
    while count:
        groups = -(-count // group_pieces)
        dealt = left.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int").alias("pack"))
        packed = materialize(dealt.groupBy("pack").applyInPandas(_pack_group(capacity, level), schema), "packed")
        if groups == 1:
            placed.append(packed)
            break
        settled = F.col("fill") >= F.lit(int(capacity * FULL_ENOUGH))
        placed.append(packed.where(settled))
        left = packed.where(~settled).select("row", "length")
        level, before = level + 1, count
        count = left.count()
        if count > before // 2:
            # Items that do not combine: packing them anew in as many groups gains nothing.
            placed.append(packed.where(~settled))
            break
    whole = pieces.where(F.col("length") == capacity).select(
        F.col("_row").alias("row"), F.lit(0).cast("bigint").alias("offset"), (-1 - F.col("_row")).alias("sequence_id")
    )
    # Levels are few, groups are below 2^31 by their size, and bins below 2^24 as each holds an item of its group.
    number = F.shiftleft(F.col("level").cast("bigint"), 56) + F.shiftleft(F.col("pack").cast("bigint"), 24) + F.col("bin")
    places = whole
    for table in placed:
        places = places.union(table.select("row", "offset", number.alias("sequence_id")))
    return pieces.join(places.withColumnRenamed("row", "_row"), "_row").drop("_row")
