"""Near-duplicate texts by deletion-variant signatures, then by shared shingles; true shingle sets decide every link."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.arrow import map_texts, texts, whole_keys
from farpoint.llm.components import connected_components, smallest_ties, tied_to_smallest
from farpoint.llm.simhash import HELD_ROWS, KEY_ROWS, bit_majority, shingle_hashes, similar_fingerprints, word_columns
from farpoint.session import materialize, release

# Similarity from which texts link, as a fraction.
LINKED = (4, 5)
# Bits of 64 in which fingerprints of the first round may differ.
FIRST_BITS = 10
# Sizes of a segment of the first round; it grows with the logarithm of the number of sets.
SEGMENT_BITS = (16, 32)
# SimHash words of a set. All of them travel with each key: by fewer, unlike sets pass that only share a frequent hash, and the number
# of these pairs grows much faster than the sets.
WORDS = 4
# Unlike bits up to which candidates are verified. A pair at 0.8 differs in 15 % of the bits (19 %, for the
# smallest sets), so fewer than one in a million such pairs differ in more.
MOST_BITS = 80
# Consecutive sets of a block; candidates are compared by pairs of blocks.
BLOCK_SETS = 128
# Shared shingles that a task spreads out at a time.
COLUMNS = 16_384
# Sets that meet under one of their rarest shingles in one task; those of a shingle that more of them hold are cut into chunks
# that meet pairwise.
GROUP_SETS = 128


def shingle_prints(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """Per row: id, hash of the text ``t0, t1`` and of its shingle set ``s0, s1``, SimHash words of the set ``w0``,
    ``w1``, ..., its ``size`` and ``prefix``.

    The prefix is the smallest hashes of the set, so many that two sets at the threshold share one of them.
    """
    part, whole = LINKED
    names = ["t0", "t1", "s0", "s1", *word_columns(WORDS), "size"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, prefixes = [], []
        for raw in texts(batch.column(3)):
            one = np.unique(shingle_hashes(raw, width))
            digest = xxhash.xxh3_128_digest(one.astype("<u8").tobytes())
            bits = bit_majority(one, WORDS) if len(one) else [0] * WORDS
            found.append([*np.frombuffer(digest, dtype="<i8").tolist(), *bits, len(one)])
            prefixes.append(one[: len(one) - -(-len(one) * part // whole) + 1].view(np.int64))
        columns = np.array(found, dtype=np.int64).reshape(-1, 3 + WORDS)
        arrays = [*(batch.column(i) for i in range(3)), *map(pa.array, columns.T.copy()), pa.array(prefixes, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=[id_column, *names, "prefix"])

    schema = f"`{id_column}` {dict(docs.dtypes)[id_column]}, {', '.join(f'{n} bigint' for n in names)}, prefix array<bigint>"
    return map_texts(docs.select(F.col(f"`{id_column}`"), *_text_key(text), F.col(f"`{text}`")), work, schema)


def _text_key(text: str) -> list[Column]:
    value = F.col(f"`{text}`")
    return [F.xxhash64(value).alias("t0"), F.xxhash64(F.lit(1), value).alias("t1")]


def _signature_pairs(sets: DataFrame, key_rows: int) -> DataFrame:
    """Candidates ``a < b``: sets whose first fingerprint words meet under a segment with one bit left out.

    Sets of one fingerprint are tied to the first of them. A task returns about as many pairs as it has fingerprints.
    """
    prints = materialize(sets.groupBy("w0").agg(F.min("n").alias("n"), F.count("*").alias("sets")), "prints")
    low, high = SEGMENT_BITS
    size = min(high, max(low, ceil(log2(max(2, prints.count())))))
    edges = similar_fingerprints(prints.select("w0"), 1, FIRST_BITS, size, key_rows)
    side = lambda name: prints.select(F.col("w0").alias(f"w{name}"), F.col("n").alias(name))
    met = edges.select(F.col("a.w0").alias("wa"), F.col("b.w0").alias("wb")).distinct().join(side("a"), "wa").join(side("b"), "wb")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = sets.select("w0", F.col("n").alias("b")).join(side("a"), F.col("w0") == F.col("wa")).where("a < b")
    found = materialize(met.union(same.select("a", "b")).distinct(), "pairs")
    release(prints)
    return found


def _shingle_pairs(sets: DataFrame, key_rows: int) -> DataFrame:
    """Some candidates ``a < b``, so that each set that has a candidate is in one of these pairs.

    Candidates are sets of different classes ``c`` that share a hash of their prefixes, with sizes and bits near enough. A
    task returns no more than two pairs for each row it reads. Hashes of more than ``key_rows`` sets are cut into chunks
    that meet pairwise. One set in so many that a chunk still counts is asked for those hashes: the number of chunks is
    layout and changes no candidate.
    """
    share = max(1, key_rows // 256)
    asked = sets.where(F.pmod(F.xxhash64(F.lit(2), "n"), F.lit(share)) == 0).select(F.explode("prefix").alias("value"))
    sizes = asked.groupBy("value").agg((F.count("*") * share).alias("rows")).where(F.col("rows") > key_rows)
    chunks = materialize(sizes.select("value", F.ceil(F.col("rows") / key_rows).cast("int").alias("chunks")), "chunks")
    rows = sets.select("n", "c", "size", *word_columns(WORDS), F.posexplode("prefix").alias("place", "value"))
    ordered = _by_chunks(rows, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_keys(batches, "key", HELD_ROWS):
            number, node = np.unique(piece["n"], return_inverse=True)
            met, found = np.zeros(len(number), dtype=bool), [np.zeros((0, 2), dtype=np.int64)]
            for left, right in _near(piece, lambda i, j: ~(met[node[i]] & met[node[j]])):
                found.append(np.sort(np.stack([piece["n"][left], piece["n"][right]], axis=1), axis=1))
                met[node[left]] = met[node[right]] = True
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(2)], names=["a", "b"])

    found = materialize(ordered.mapInArrow(run, "a bigint, b bigint").distinct(), "pairs")
    release(chunks)
    return found


def _by_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows`` dealt by their ``key`` and sorted by it and the class: their ``value``, or each pair of chunks for the values in ``chunks``."""
    own = F.pmod(F.xxhash64("n"), F.col("chunks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64(F.col("value"), F.least(own, x), F.greatest(own, x))
    )
    keyed = rows.join(chunks, "value", "left").withColumn("key", F.explode(F.coalesce(others, F.array("value"))))
    columns = ["key", "n", "c", "size", "place", *word_columns(WORDS)]
    return keyed.select(*columns).repartition("key").sortWithinPartitions("key", "c")


def _near(piece: dict[str, np.ndarray], asked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of equal key (sorted) whose classes differ and whose sizes and bits are near, if ``asked`` for.

    The first hash of its prefix that a set shares with another has a ``place`` that leaves room for all they must share; at
    later ones a pair may be passed over. Rows of a class are together within a key, and each row meets those after its class only.
    """
    (part, whole), key, classes, size = LINKED, piece["key"], piece["c"], piece["size"]
    bits = np.stack([piece[w] for w in word_columns(WORDS)], axis=1).view(np.uint64)
    rest = size - piece["place"]
    key_end = np.searchsorted(key, key, side="right")
    starts = np.flatnonzero((key[1:] != key[:-1]) | (classes[1:] != classes[:-1])) + 1
    class_end = np.append(starts, len(key))[np.searchsorted(starts, np.arange(len(key)), side="right")]
    left, lag = np.arange(len(key)), 0
    while True:
        left = left[class_end[left] + lag < key_end[left]]
        if not len(left):
            return
        right = class_end[left] + lag
        lag += 1
        close = np.minimum(size[left], size[right]) * whole >= np.maximum(size[left], size[right]) * part
        close &= np.minimum(rest[left], rest[right]) * (part + whole) >= (size[left] + size[right]) * part
        a, b = left[close], right[close]
        a, b = (x[asked(a, b)] for x in (a, b))
        close = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= MOST_BITS
        if close.any():
            yield a[close], b[close]


def _linked_by_blocks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose similarity reaches the threshold, with the pair of blocks ``g`` in which they were compared.

    ``sets`` has ``n`` and an array ``v``. Each pair of blocks is a group of its own, which gets each set that a pair
    in it needs once.
    """
    block = lambda name: F.floor(F.col(name) / BLOCK_SETS)
    placed = pairs.select("a", "b", F.xxhash64(block("a"), block("b")).alias("g"))
    needed = placed.select(F.col("g").alias("h"), F.explode(F.array("a", "b")).alias("n")).distinct()

    def compare(pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("n")
        numbers = held["n"].to_numpy()
        a, b = (np.searchsorted(numbers, pairs[side].to_numpy()) for side in "ab")
        return pairs[_sets_near([np.asarray(v) for v in held["v"]])[a, b]]

    sides = placed.groupBy("g").cogroup(needed.join(sets, "n").select("h", "n", "v").groupBy("h"))
    return sides.applyInPandas(compare, "a bigint, b bigint, g bigint")


def _sets_near(values: list[np.ndarray]) -> np.ndarray:
    """Whether two of the sets have a Jaccard similarity of at least the threshold, as a matrix."""
    part, whole = LINKED
    sizes = np.array([len(v) for v in values])
    _, place, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    several = count > 1
    column = np.where(several, np.cumsum(several) - 1, -1)[place.reshape(-1)]
    row = np.repeat(np.arange(len(values)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(values), len(values)), dtype=np.float64)
    for start in range(0, int(several.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(values), COLUMNS), dtype=np.float32)
        held[row[lo:hi], column[lo:hi] - start] = 1
        shared += held @ held.T
    # shared / (all - shared) >= part / whole
    return shared * (part + whole) >= (sizes[:, None] + sizes[None, :]) * part


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """Ties between sets that join the same sets as those ``pairs`` whose Jaccard similarity reaches the threshold."""
    sketch = lambda side: sets.select(F.col("n").alias(side), *[F.col(w).alias(f"{side}{w}") for w in word_columns(WORDS)])
    unlike = [F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in word_columns(WORDS)]
    met = pairs.join(sketch("a"), "a").join(sketch("b"), "b")
    near = materialize(met.where(sum(unlike[1:], unlike[0]) <= MOST_BITS).select("a", "b"), "near")
    whole = _sets_of(near, sets, docs, text, width)
    links = materialize(tied_to_smallest(_linked_by_blocks(near, whole), "g"), "links")
    release(near)
    release(whole)
    return links


def _sets_of(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """``n`` and the hashes ``v`` of the sets in ``pairs``, made from their texts."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    # Rows of equal text give the same set; one is enough.
    named = sets.join(nodes, "n").select("n", "t.t0", "t.t1")
    held = docs.select(*_text_key(text), F.col(f"`{text}`").alias("_text")).join(named, ["t0", "t1"])
    held = held.groupBy("n").agg(F.first("_text").alias("_text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(raw, width)).view(np.int64) for raw in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["n", "v"])

    return materialize(map_texts(held, work, "n bigint, v array<bigint>"), "sets")


def _rarest_links(sets: DataFrame, whole: DataFrame) -> DataFrame:
    """Ties between sets of different classes ``c`` that join the same classes as all their links.

    ``whole`` has ``n`` and the hashes ``v`` of some of the ``sets``, whose links among them are found. Two sets at the
    threshold share one of their first hashes in any one order. Here the hash that the fewest sets hold comes
    first, so that sets of a crowd, which share most hashes, meet only if they have few of their own. Sets that meet a near one
    under a hash are compared by their true sets in a group of that hash, and no pair leaves its group.
    """
    (part, of), words = LINKED, word_columns(WORDS)
    rows = whole.select("n", F.size("v").alias("all"), F.explode("v").alias("value"))
    often = rows.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("n")
    # Hashes that no other set holds come before the others.
    place = F.col("all") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "value")) - 1
    placed = rows.join(often, "value").select("n", "all", "value", place.alias("place"))
    first = placed.where(F.col("place") <= F.col("all") - F.ceil(F.col("all") * part / of)).select("n", "place", "value")
    first = materialize(first.join(sets.select("n", "c", "size", *words), "n"), "rarest")
    counts = first.groupBy("value").agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP_SETS)
    ordered = _by_chunks(first, counts.select("value", F.ceil(F.col("rows") / GROUP_SETS).cast("int").alias("chunks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in whole_keys(batches, "key", HELD_ROWS):
            met = np.zeros(len(piece["key"]), dtype=bool)
            for left, right in _near(piece, lambda i, j: ~(met[i] & met[j])):
                met[left] = met[right] = True
            yield pa.RecordBatch.from_arrays([pa.array(piece[x][met]) for x in ("key", "n")], names=["g", "n"])

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        number = held["n"].to_numpy()
        a, b = np.nonzero(np.triu(_sets_near([np.asarray(v) for v in held["v"]]), 1))
        return pd.DataFrame(dict(zip("ab", smallest_ties(number[a], number[b]))))

    met = ordered.mapInArrow(run, "g bigint, n bigint")
    links = materialize(met.join(whole, "n").groupBy("g").applyInPandas(compare, "a bigint, b bigint"), "links")
    release(first)
    return links


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per input row: id and ``component_id``, the smallest id reachable by links, itself included.

    Texts link if their sets of ``width``-word shingles have a Jaccard similarity of at least ``LINKED``. Equal sets are
    one node. A first round brings sets together by deletion-variant signatures of their SimHash, about one pair for each
    member of a crowd of near copies, and joins those whose true sets reach the threshold. Signatures miss pairs whose bits
    differ in every segment, so a second round looks for sets that share one of their smallest hashes (two sets at
    the threshold do) and have near bits, but are of different classes. Those that have such a partner meet anew under their
    rarest hashes and are compared by their true sets.
    NULL and empty texts are copies of each other. A row without an id gets its component but gives none its name.
    Repeated rows stay. An empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    prints = materialize(shingle_prints(docs, id_column, text, width), "prints")
    words = word_columns(WORDS)
    grouped = prints.groupBy("s0", "s1").agg(
        F.min(id_column).alias("first"), F.min(F.struct("t0", "t1")).alias("t"), F.first("size").alias("size"),
        F.first("prefix").alias("prefix"), *[F.first(w).alias(w) for w in words],
    )
    distinct = materialize(grouped, "distinct")
    # Numbers follow the smallest hash, so that most sets of a crowd share few blocks.
    ordered = distinct.orderBy(F.get("prefix", F.lit(0)), "s0", "s1").withColumn("n", F.monotonically_increasing_id())
    sets = materialize(ordered, "numbered")
    release(distinct)
    pairs = _signature_pairs(sets, key_rows)
    first = _verified(pairs, sets, docs, text, width)
    release(pairs)
    roots = materialize(connected_components(first), "roots")
    joined = sets.select("n", "size", *word_columns(WORDS), "prefix").join(roots, sets["n"] == roots["node"], "left")
    classed = materialize(joined.withColumn("c", F.coalesce("root", "n")).drop("node", "root"), "classed")
    release(roots)
    pairs = _shingle_pairs(classed, key_rows)
    whole = _sets_of(pairs, sets, docs, text, width)
    release(pairs)
    second = _rarest_links(classed, whole)
    release(classed)
    release(whole)
    roots = materialize(connected_components(first.union(second)), "roots")
    named = sets.select("s0", "s1", "first", "n").join(roots, sets["n"] == roots["node"], "left")
    named = materialize(named.select("s0", "s1", "first", F.coalesce("root", "n").alias("root")), "classes")
    release(first)
    release(second)
    release(sets)
    several = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = named.join(several, "root", "left").select("s0", "s1", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(classes, ["s0", "s1"]).select(id_column, "component_id")
