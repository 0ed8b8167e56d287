"""Near-duplicate texts by SimHash fingerprints and deletion-variant segment signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.arrow import map_texts, texts, whole_keys
from farpoint.llm.components import connected_components
from farpoint.session import materialize

SEED = 42
WORD_BITS = 64
# Fingerprints that one signature key may bring together in one task; keys above it are cut into chunks that
# meet pairwise.
KEY_ROWS = 4096
# Rows of sorted keys that a task holds at a time.
HELD_ROWS = 200_000
# Shingles whose bits are counted at a time.
COUNTED = 65_536


def fingerprint(raw: bytes, width: int, words: int = 1) -> list[int]:
    """SimHash of a text as signed 64-bit words; a text without words has fingerprint zero.

    Letters A-Z are lower-cased, words are runs without ASCII white space, shingles are ``width``
    words joined by a space, each as often as it occurs (fewer words: the whole sequence). A bit is
    set if it is set in over half of the shingle hashes. Further fingerprint words come from a
    bijective mix of the same hashes.
    """
    hashes = shingle_hashes(raw, width)
    return bit_majority(hashes, words) if len(hashes) else [0] * words


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """Hash of each shingle of a text, as often as it occurs; none for a text without words."""
    tokens = raw.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    spans = zip(starts, (e - 1 for e in ends[width - 1 :])) if len(tokens) >= width else [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def bit_majority(hashes: np.ndarray, words: int) -> list[int]:
    """Fingerprint words of shingle hashes: the bits that over half of them have."""
    found = []
    for word in range(words):
        h = hashes if word == 0 else _mixed(hashes, word)
        counts = np.zeros(WORD_BITS, dtype=np.int64)
        for start in range(0, len(h), COUNTED):
            part = h[start : start + COUNTED].astype("<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint32)
        packed = np.packbits(counts * 2 > len(h), bitorder="little")
        found.append(int(packed.view("<i8")[0]))
    return found


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another hash of each value: a bijection of 64-bit numbers."""
    h = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """``id_column`` and fingerprint words ``w0``, ``w1``, ... of each row; NULL text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, width, words) for t in texts(batch.column(1))], dtype=np.int64)
        found = found.reshape(-1, words)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(found[:, w]) for w in range(words))], names=[id_column, *word_columns(words)]
        )

    schema = ", ".join([f"`{id_column}` {dict(docs.dtypes)[id_column]}", *(f"{w} bigint" for w in word_columns(words))])
    return map_texts(docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")), work, schema)


def word_columns(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def segments(words: int, max_distance: int, segment_bits: int | None = None) -> list[tuple[int, int, int, int]]:
    """Segments (word, lowest bit, bits, wildcards 0 or 1) of a fingerprint.

    Without ``segment_bits`` the one word is cut into ``max_distance // 2 + 1`` segments. Of two
    fingerprints within the distance, one segment then differs by at most one bit, and if that is the last
    one only, all earlier segments have used two bits each. So no link is missed. With ``segment_bits`` every word is cut into
    segments of that size, which finds links with a chance that the caller states.
    """
    if segment_bits is None:
        if words != 1:
            raise ValueError("segments without a miss need a fingerprint of one word")
        count = max_distance // 2 + 1
        edges = [round(i * WORD_BITS / count) for i in range(count + 1)]
        return [(0, lo, hi - lo, min(1, max_distance - 2 * i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return [(w, lo, segment_bits, 1) for w in range(words) for lo in range(0, WORD_BITS - segment_bits + 1, segment_bits)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _variants(cuts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(number, segment, word, mask): the key of a variant is its number and the word under its mask."""
    found: list[tuple[int, int, int, int]] = []
    for s, (word, lo, size, wildcards) in enumerate(cuts):
        whole = ((1 << size) - 1) << lo
        for mask in [whole & ~(1 << b) for b in range(lo, lo + size)] if wildcards else [whole]:
            found.append((len(found), s, word, mask))
    return found


def _structs(rows: list[tuple[int, ...]], names: list[str], columns: list[Column]) -> Column:
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)], c.alias("value")) for row, c in zip(rows, columns)])


def similar_fingerprints(
    distinct: DataFrame,
    words: int,
    max_distance: int,
    segment_bits: int | None = None,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Edges between distinct fingerprints of at most ``max_distance`` differing bits, as structs ``a``, ``b``.

    Each fingerprint is indexed under its segments with one bit left out in turn; rows that share a key
    are verified on all bits. Of the verified pairs a task returns only those that join two of
    its classes, so a class of n members gives about n edges and no link between classes is lost.
    Segment values are counted beforehand; keys with more than ``key_rows`` fingerprints are cut
    into chunks, and each pair of chunks meets in a group of its own.
    """
    names = word_columns(words)
    cuts = segments(words, max_distance, segment_bits)
    variants = _variants(cuts)
    whole = [(s, F.col(f"w{w}").bitwiseAND(F.lit(_signed(((1 << size) - 1) << lo)))) for s, (w, lo, size, _) in enumerate(cuts)]
    values = _structs([(s,) for s, _ in whole], ["segment"], [c for _, c in whole])
    crowded = (
        distinct.select(F.explode(values).alias("x"))
        .groupBy("x.segment", "x.value")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") * 2 > key_rows)
    )
    masks = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(s).alias("segment"), F.lit(_signed(m)).alias("mask")) for n, s, _, m in variants])
    chunks = (
        crowded.select("segment", "value", "n", F.explode(masks).alias("m"))
        .where(F.col("m.segment") == F.col("segment"))
        .groupBy(F.col("m.variant").alias("variant"), F.col("value").bitwiseAND(F.col("m.mask")).alias("value"))
        .agg(F.ceil((F.sum("n") + key_rows) / key_rows).cast("int").alias("chunks"))
    )
    chunks = materialize(chunks, "chunks")
    keyed = _structs([(n,) for n, *_ in variants], ["variant"], [F.col(f"w{w}").bitwiseAND(F.lit(_signed(m))) for _, _, w, m in variants])
    rows = distinct.select(*names, F.explode(keyed).alias("x")).select(*names, "x.variant", "x.value")
    own = F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(own, c).alias("i"), F.greatest(own, c).alias("j")))
    meeting = F.explode(F.coalesce(others, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))))
    rows = rows.join(chunks, ["variant", "value"], "left").select(*names, "variant", "value", meeting.alias("c"))
    keys = rows.select(F.xxhash64("variant", "value", "c.i", "c.j").alias("key"), *names)
    ordered = keys.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_keys(batches, "key", HELD_ROWS):
            links = _links(piece["key"], np.stack([piece[n] for n in names], axis=1), max_distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(links[:, side, i]) for side in range(2) for i in range(words)],
                names=[f"{side}{i}" for side in "ab" for i in range(words)],
            )

    schema = ", ".join(f"{side}{i} bigint" for side in "ab" for i in range(words))
    found = ordered.mapInArrow(run, schema)
    return found.select(*[F.struct(*[F.col(f"{side}{i}").alias(f"w{i}") for i in range(words)]).alias(side) for side in "ab"])


def _links(key: np.ndarray, prints: np.ndarray, max_distance: int) -> np.ndarray:
    """Pairs within the distance among rows of equal key (sorted) that join two classes of the piece."""
    if prints.shape[1] == 1:
        single, node = np.unique(prints[:, 0], return_inverse=True)
        distinct = single.reshape(-1, 1)
    else:
        distinct, node = np.unique(prints, axis=0, return_inverse=True)
    node = node.reshape(-1)
    words = prints.view(np.uint64)
    parent = np.arange(len(distinct))
    found: list[tuple[int, int]] = []
    left = np.arange(len(key))
    lag = 0
    while True:
        lag += 1
        left = left[left + lag < len(key)]
        left = left[key[left + lag] == key[left]]
        if not len(left):
            break
        near = left[np.bitwise_count(words[left] ^ words[left + lag]).sum(axis=1) <= max_distance]
        a, b = node[near], node[near + lag]
        apart = parent[a] != parent[b]
        if not apart.any():
            continue
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            rx, ry = _root(parent, x), _root(parent, y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                found.append((x, y))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return distinct[pairs]


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def simhash_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = 3,
    max_distance: int = 2,
    words: int = 1,
    segment_bits: int | None = None,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """One row per input row: id, fingerprint words and ``component_id``.

    Texts link if their fingerprints differ by at most ``max_distance`` bits; the component is the
    smallest id reachable by links, itself included. Equal fingerprints are one node, so copies are never expanded.
    NULL and empty texts have fingerprint zero and link like any other. A row without an id gets
    its component but gives none its name (NULL if no row of the class has an id). Repeated rows stay. An empty table
    gives an empty table. Other columns of ``docs`` are not read.
    """
    names = word_columns(words)
    prints = materialize(fingerprints(docs, id_column, text, width, words), "prints")
    distinct = materialize(prints.groupBy(*names).agg(F.min(id_column).alias("first")), "distinct")
    edges = similar_fingerprints(distinct, words, max_distance, segment_bits, key_rows)
    node = F.struct(*names)
    if words == 1:
        edges, node = edges.select(F.col("a.w0").alias("a"), F.col("b.w0").alias("b")), F.col("w0")
    roots = connected_components(edges)
    grouped = distinct.select("*", node.alias("node")).join(roots, "node", "left")
    grouped = materialize(grouped.select(*names, "first", F.coalesce("root", "node").alias("root")), "classes")
    joined = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    several = joined.where("prints > 1").select("root", "component_id")
    classes = grouped.join(several, "root", "left").select(*names, F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(classes, names).select(id_column, *names, "component_id")


def keep_first(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that are in a class with a smaller id; rows without an id stay."""
    later = classes.where(F.col("component_id") < F.col(id_column)).select(id_column).distinct()
    return docs.join(later, id_column, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
