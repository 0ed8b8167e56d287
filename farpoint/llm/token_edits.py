"""Token counts that follow edits: segment trees over pre-tokens, re-encoded only where edits touch."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.arrow import map_texts, texts
from farpoint.llm.tokens import encoder, tokenizer_path

# Characters of a leaf, up to the end of the white space that follows.
LEAF_CHARS = 512
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_WHITE = " \t\n\v\f\r"

TREE = "struct<chars: array<bigint>, tokens: array<bigint>>"


def cut(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """Leaves of a text: each but the last ends with white space, so no pre-token crosses a leaf."""
    leaves, start = [], 0
    while start < len(text):
        gap = _GAP.search(text, start + leaf_chars)
        end = gap.end() if gap else len(text)
        leaves.append(text[start:end])
        start = end
    return leaves


class SegmentTree:
    """Sums over leaves in a flat array: node i has children 2i and 2i + 1, the root is node 1."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums
        self.leaves = len(sums) // 2

    @classmethod
    def build(cls, values: list[int]) -> SegmentTree:
        size = 1 << max(0, (len(values) - 1).bit_length())
        sums = np.zeros(2 * size, dtype=np.int64)
        sums[size : size + len(values)] = values
        while size > 1:
            sums[size // 2 : size] = sums[size : 2 * size : 2] + sums[size + 1 : 2 * size : 2]
            size //= 2
        return cls(sums)

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds position ``place`` of the summed lengths, and the sum before it."""
        node, before = 1, 0
        while node < self.leaves:
            node *= 2
            if place - before >= self.sums[node]:
                before += int(self.sums[node])
                node += 1
        return node - self.leaves, before

    def set(self, leaf: int, value: int) -> None:
        node = self.leaves + leaf
        change = value - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def build_tree(text: str, count, leaf_chars: int) -> tuple[SegmentTree, SegmentTree]:
    leaves = cut(text, leaf_chars)
    return SegmentTree.build([len(x) for x in leaves]), SegmentTree.build([count(x) for x in leaves])


def apply_edits(
    text: str, chars: SegmentTree, tokens: SegmentTree, edits: Iterable[tuple[int, int, str]], count
) -> tuple[str, int]:
    """Edit the trees in place; the new text and the characters that were encoded anew.

    ``edits`` are (start, length, replacement) in characters of ``text`` and do not overlap; those at one
    place apply in the order given. Leaves that an edit touches are encoded anew together, and with them the next leaf if
    what is left of the last one no longer ends with white space (a pre-token may then go on into it). The new count sits in
    the first leaf of such a run, which keeps all other leaves and their place.
    """
    original = SegmentTree(chars.sums.copy())
    pieces, at, encoded = [], 0, 0
    edits = sorted(edits, key=lambda e: (e[0], e[0] + e[1]))
    i = 0
    while i < len(edits):
        first, begin = original.find(min(edits[i][0], max(len(text) - 1, 0)))
        # An edit right at the start of a leaf may join it to the leaf before.
        if begin == edits[i][0] and first > 0:
            first, begin = original.find(begin - 1)
        last, end, new, place = first, begin + int(original.sums[original.leaves + first]), [], begin
        while True:
            while i < len(edits) and (edits[i][0] <= end or end == len(text)):
                start, length, replacement = edits[i]
                new.append(text[place:start])
                new.append(replacement)
                place = start + length
                i += 1
                while end < min(place, len(text)) or (end == place and end < len(text)):
                    last, _ = original.find(end)
                    end += int(original.sums[original.leaves + last])
            tail = text[place:end]
            whole = "".join(new) + tail
            if end >= len(text) or not whole or whole[-1] in _WHITE:
                break
            new.append(tail)
            place = end
            last, _ = original.find(end)
            end += int(original.sums[original.leaves + last])
        pieces.append(text[at:begin])
        pieces.append(whole)
        at, encoded = end, encoded + len(whole)
        for leaf in range(first, last + 1):
            chars.set(leaf, len(whole) if leaf == first else 0)
            tokens.set(leaf, count(whole) if leaf == first else 0)
    pieces.append(text[at:])
    return "".join(pieces), encoded


def _edits_by_row(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, lengths and replacements of each row's edits; those without a start or length are left out."""
    offsets = column.offsets.to_numpy()
    edits = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    start, length, replacement = (edits.field(name) for name in ("start", "length", "replacement"))
    known = [x.is_valid().to_numpy(zero_copy_only=False) for x in (edits, start, length)]
    used = known[0] & known[1] & known[2]
    numbers = [x.fill_null(0).to_numpy() for x in (start, length)]
    new = replacement.fill_null("").to_numpy(zero_copy_only=False)
    for given, low, high in zip(column.is_valid().to_pylist(), offsets, offsets[1:]):
        kept = low + np.flatnonzero(used[low:high]) if given else np.zeros(0, dtype=np.int64)
        yield numbers[0][kept], numbers[1][kept], new[kept]


def token_trees(docs: DataFrame, text: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS, name: str = "tree") -> DataFrame:
    """``docs`` with the segment tree of each text. NULL text counts as empty: a tree of one leaf with sum 0."""
    path = path or tokenizer_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = lambda leaf: len(encoder(path).ids(leaf.encode()))
        trees = [build_tree(t.decode("utf-8", "replace"), count, leaf_chars) for t in texts(batch.column(0))]
        sums = [{"chars": c.sums.tolist(), "tokens": t.sums.tolist()} for c, t in trees]
        kind = pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums, kind)], names=["_row", "_tree"])

    others = [c for c in docs.columns if c != name]
    held = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"))
    done = map_texts(held, work, f"_row {held.schema['_row'].dataType.simpleString()}, _tree {TREE}")
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in others], F.col("_tree").alias(name))


def edited_counts(
    trees: DataFrame, edits: str = "edits", text: str = "text", tree: str = "tree", path: str | None = None
) -> DataFrame:
    """``trees`` with text and tree after the edits, ``n_before``, ``n_after`` and ``n_encoded`` characters.

    ``edits`` is an array of structs (``start``, ``length``, ``replacement``) in characters of the text. They must not
    overlap, so a row's edits are bounded by its text; a start or end beyond the text counts as its end.
    NULL edits and those with a NULL start or length are none; NULL text is empty; a NULL replacement is empty. Rows are independent, so repeated
    rows and ties give equal results. An empty table gives an empty table. Columns called like the results are replaced.
    """
    path = path or tokenizer_path()
    names = ["n_before", "n_after", "n_encoded"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = lambda leaf: len(encoder(path).ids(leaf.encode()))
        new_texts, new_trees, numbers = [], [], []
        for raw, sums, (start, length, replacement) in zip(texts(batch.column(0)), batch.column(1).to_pylist(), _edits_by_row(batch.column(2))):
            old = raw.decode("utf-8", "replace")
            chars, tokens = (SegmentTree(np.array(sums[c], dtype=np.int64)) for c in ("chars", "tokens"))
            before = tokens.total
            begin, end = (np.clip(x, 0, len(old)) for x in (start, start + length))
            plain = zip(begin.tolist(), (end - begin).tolist(), replacement.tolist())
            new, encoded = apply_edits(old, chars, tokens, plain, count)
            new_texts.append(new)
            new_trees.append({"chars": chars.sums.tolist(), "tokens": tokens.sums.tolist()})
            numbers.append((before, tokens.total, encoded))
        kind = pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
        columns = [batch.column(3), pa.array(new_texts, pa.string()), pa.array(new_trees, kind)]
        columns += [pa.array([n[i] for n in numbers], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["_row", "_text", "_tree", *names])

    others = [c for c in trees.columns if c not in (text, tree, edits, *names)]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_row")
    held = trees.select(F.col(f"`{text}`").alias("_text"), F.col(f"`{tree}`").alias("_tree"), F.col(f"`{edits}`").alias("_edits"), row)
    numbers = ", ".join(f"{n} bigint" for n in names)
    done = map_texts(held, work, f"_row {held.schema['_row'].dataType.simpleString()}, _text string, _tree {TREE}, {numbers}")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in others]
    return done.select(*kept, F.col("_text").alias(text), F.col("_tree").alias(tree), *names)


def replacements(docs: DataFrame, pattern: str, replacement: str, text: str = "text", name: str = "edits") -> DataFrame:
    """``docs`` with the edits that replace what a regular expression matches in the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        search = re.compile(pattern)
        spans, offsets = [], [0]
        for raw in texts(batch.column(0)):
            spans.extend(m.span() for m in search.finditer(raw.decode("utf-8", "replace")))
            offsets.append(len(spans))
        start, end = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        columns = [pa.array(start), pa.array(end - start), pa.array([replacement] * len(spans), pa.string())]
        edits = pa.StructArray.from_arrays(columns, names=["start", "length", "replacement"])
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), edits)
        return pa.RecordBatch.from_arrays([batch.column(1), found], names=["_row", "_edits"])

    others = [c for c in docs.columns if c != name]
    held = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"))
    edits = "array<struct<start: bigint, length: bigint, replacement: string>>"
    done = map_texts(held, work, f"_row {held.schema['_row'].dataType.simpleString()}, _edits {edits}")
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in others], F.col("_edits").alias(name))
