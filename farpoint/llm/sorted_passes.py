"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.arrow import map_texts
from farpoint.llm.components import connected_components, smallest_ties, tied_to_smallest
from farpoint.llm.vectors import matrix, usable, usable_rows
from farpoint.operators.numbering import number_rows
from farpoint.session import materialize, release

SEED = 11
BITS = 64
# Rows of the sorted order that each row is compared with.
WINDOW = 16
# Rows of the sorted order per task group.
BLOCK = 4096
# Chance to miss a pair whose cosine is just the threshold.
MISS = 0.01
# Hashes that runs of equal prefixes may be longer than for even rows, where crowds ask for it.
DEEPER = range(0, 17, 4)
# Comparisons of vectors in a run that take about as long as one row in one pass.
ROW_COST = 2000
# Vectors of one class or run that a task compares with each other at a time.
CHUNK = 1024


def even_depth(rows: int, window: int = WINDOW) -> int:
    """Leading hashes that no more than a window of rows shares, were the rows spread evenly."""
    return max(0, ceil(log2(max(rows, 1) / window)))


def passes_needed(depth: int, threshold: float, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has agreed on ``depth`` leading hashes but for a chance of ``miss``."""
    agree = (1 - acos(min(1.0, threshold)) / pi) ** depth
    return 1 if agree >= 1 else max(1, ceil(log(miss) / log(1 - agree)))


def _planes(dimension: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dimension]).standard_normal((dimension, BITS))


def _codes(vectors: DataFrame, numbers: range, seed: int) -> DataFrame:
    """Per vector and pass the concatenated signs of ``BITS`` random projections."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = batch.column(0).to_numpy(), []
        values = batch.column(1).to_pylist()
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(values):
            by_length.setdefault(len(v), []).append(i)
        for length, places in by_length.items():
            rows = matrix([values[i] for i in places])
            rows /= np.abs(rows).max(axis=1, keepdims=True)
            for number in numbers:
                bits = rows @ _planes(length, number, seed) > 0
                codes = np.packbits(bits, axis=1, bitorder="big").view(">u8").reshape(-1).astype(np.uint64)
                found.append((ids[places], np.full(len(places), number), np.full(len(places), length), codes.view(np.int64)))
        columns = [np.concatenate([f[c] for f in found]) for c in range(4)] if found else [np.zeros(0, np.int64)] * 4
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], names=["_id", "_pass", "_length", "_code"])

    return map_texts(vectors.select("_id", "_v"), work, "_id bigint, _pass int, _length int, _code bigint")


def _window_pairs(codes: DataFrame, window: int, block: int, most_bits: int) -> DataFrame:
    """Pairs of rows of a pass at most ``window`` apart in code order whose codes differ in few bits.

    ``codes`` has a class ``_class``; pairs of one class are left out. A pair has one ``home``, a block in which it met.
    """
    numbered = number_rows(codes, ["_code", "_id"], key=["_pass", "_length"], seq="_seq", total="_rows")
    own = F.expr(f"(_seq - 1) div {block}")
    blocks = F.when((F.col("_seq") - 1) % block < window, F.array(own, own - 1)).otherwise(F.array(own))
    copied = numbered.select("*", own.alias("_own"), F.explode(blocks).alias("_block")).where("_block >= 0")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")
        code = pdf["_code"].to_numpy().view(np.uint64)
        ids, group = pdf["_id"].to_numpy(), pdf["_class"].to_numpy()
        here = (pdf["_own"] == pdf["_block"]).to_numpy()
        left, right = [], []
        for lag in range(1, min(window, len(code) - 1) + 1):
            near = np.bitwise_count(code[:-lag] ^ code[lag:]) <= most_bits
            near &= here[:-lag] & (group[:-lag] != group[lag:])
            left.append(ids[:-lag][near])
            right.append(ids[lag:][near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        home = pdf["_home"].to_numpy()[:1].repeat(len(a))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "home": home})

    home = F.xxhash64("_pass", "_length", "_block").alias("_home")
    columns = ["_own", "_block", "_seq", "_code", "_id", "_class"]
    met = copied.select(home, *columns).groupBy("_home").applyInPandas(compare, "a bigint, b bigint, home bigint")
    return met.groupBy("a", "b").agg(F.min("home").alias("home"))


def _run(depth: int) -> Column:
    return F.lit(0).cast("bigint") if depth == 0 else F.shiftrightunsigned("_code", BITS - depth)


def _measured_depth(codes: DataFrame, rows: int, threshold: float, window: int, miss: float) -> int:
    """Leading hashes of a run: as many as make the pairs of all runs and the rows of all passes cheapest together.

    ``codes`` has one pass over all rows and their classes. Rows alike but below the threshold crowd in few runs; longer
    prefixes part them and ask for more passes.
    """
    even = even_depth(rows, window)
    depths = [even + d for d in DEEPER if even + d < BITS]
    choices = F.array(*[F.struct(F.lit(d).alias("_depth"), _run(d).alias("_run")) for d in depths])
    runs = codes.select("_length", "_class", F.explode(choices).alias("_r")).groupBy("_length", "_r", "_class").agg(F.count("*").alias("n"))
    runs = runs.groupBy("_length", "_r").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    pairs = runs.groupBy(F.col("_r._depth").alias("depth")).agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("same")) / 2).alias("pairs"))
    found = {row["depth"]: row["pairs"] for row in pairs.collect()}
    return min(depths, key=lambda d: passes_needed(d, threshold, miss) * (ROW_COST * rows + found.get(d, 0.0)))


def _run_links(codes: DataFrame, vectors: DataFrame, depth: int, threshold: float, window: int, chunk: int) -> DataFrame | None:
    """Ties ``a``, ``b`` between classes with linked members in one run; None if windows have seen all runs.

    A run is the rows of a pass that share ``depth`` leading hashes. Rows of a run that fits a window have met there. Of
    larger runs, every two rows of different classes are compared: chunks meet pairwise, each pair in a group of its
    own. A class of more than a chunk has chunks of its own, which don't meet each other.
    """
    keys = ["_pass", "_length", "_run"]
    rows = codes.select("_pass", "_length", _run(depth).alias("_run"), "_id", "_class")
    classes = rows.groupBy(*keys, "_class").agg(F.count("*").alias("_n"))
    large = F.when(F.col("_n") > chunk, F.ceil(F.col("_n") / chunk)).otherwise(0)
    runs = classes.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"), F.count("*").alias("_classes"), F.sum(large).cast("int").alias("_pure"),
        F.sum(F.when(large == 0, F.col("_n")).otherwise(0)).alias("_others"),
    )
    crowded = runs.where((F.col("_rows") > window + 1) & (F.col("_classes") > 1))
    crowded = materialize(crowded.select(*keys, "_pure", F.ceil(F.col("_others") / chunk).cast("int").alias("_mixed")), "runs")
    if crowded.isEmpty():
        release(crowded)
        return None
    before = Window.partitionBy(*keys).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    own_chunks = large.cast("int").alias("_chunks")
    pure = classes.where(large > 0).select(*keys, "_class", own_chunks).withColumn("_start", F.coalesce(F.sum("_chunks").over(before), F.lit(0)))
    placed = rows.join(crowded, keys).join(pure, [*keys, "_class"], "left")
    first, hashed = F.col("_mixed") + F.col("_start"), F.xxhash64("_id")
    own = F.when(first.isNotNull(), first + F.pmod(hashed, F.col("_chunks"))).otherwise(F.pmod(hashed, F.col("_mixed"))).cast("int")
    every = F.sequence(F.lit(0), F.col("_mixed") + F.col("_pure") - 1)
    apart = lambda c: F.coalesce((c < first) | (c >= first + F.col("_chunks")), F.lit(True))
    placed = placed.withColumn("_own", own).withColumn("_other", F.explode(F.filter(every, apart)))
    meeting = placed.select(*keys, "_own", "_id", "_class", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first = (pdf["_own"] == pdf["i"]).to_numpy()
        second = first if pdf["i"].iloc[0] == pdf["j"].iloc[0] else ~first
        vectors, group = _unit(matrix(pdf["_v"])), pdf["_class"].to_numpy()
        left, right = np.nonzero(vectors[first] @ vectors[second].T >= threshold)
        ends = np.unique(np.stack([group[first][left], group[second][right]], axis=1), axis=0)
        return pd.DataFrame(dict(zip("ab", smallest_ties(*ends[ends[:, 0] != ends[:, 1]].T))))

    held = meeting.join(vectors.select("_id", "_v"), "_id")
    ties = held.groupBy(*keys, "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()
    found = materialize(ties, "ties")
    release(crowded)
    return found


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not batch.num_rows:
            return batch.select(["a", "b", "home"])
        keep = []
        for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            x, y = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)
            keep.append(bool(_unit(x[None])[0] @ _unit(y[None])[0] >= threshold))
        return batch.select(["a", "b", "home"]).filter(pa.array(keep))

    side = lambda name: vectors.select(F.col("_id").alias(name), F.col("_v").alias(f"_v{name}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "home", "_va", "_vb")
    return map_texts(joined, work, "a bigint, b bigint, home bigint")


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that large and small components don't overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _class_links(members: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """Per vector the rows of its class that reach the threshold with it, other than its own copies.

    ``members`` has ``_class``, ``_id``, ``_n`` (copies) and ``_v``. Classes are cut into chunks and each
    pair of chunks is compared in a group of its own; only sums per vector leave it.
    """
    sizes = members.groupBy("_class").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks"))
    own = F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int").alias("_own")
    cut = members.join(sizes, "_class").select("*", own)
    each = F.transform(
        F.sequence(F.lit(0), F.col("_chunks") - 1),
        lambda c: F.struct(F.least("_own", c).alias("i"), F.greatest("_own", c).alias("j")),
    )
    meeting = cut.select("_class", "_own", "_id", "_n", "_v", F.explode(each).alias("_p")).select("*", "_p.i", "_p.j")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        first = (pdf["_own"] == i).to_numpy()
        rows, ids, copies = _unit(matrix(pdf["_v"])), pdf["_id"].to_numpy(), pdf["_n"].to_numpy()
        near = rows[first] @ rows[first if i == j else ~first].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"_id": ids, "_links": near @ copies})
        links = np.concatenate([near @ copies[~first], near.T @ copies[first]])
        return pd.DataFrame({"_id": np.concatenate([ids[first], ids[~first]]), "_links": links})

    counted = meeting.drop("_p").groupBy("_class", "i", "j").applyInPandas(count, "_id bigint, _links bigint")
    return counted.groupBy("_id").agg(F.sum("_links").alias("_links"))


def _roots(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links), "roots").select(F.col("node").alias("_id"), "root")


def _classed(codes: DataFrame, roots: DataFrame) -> DataFrame:
    return codes.join(roots, "_id", "left").withColumn("_class", F.coalesce("root", "_id")).drop("root")


def near_duplicate_vectors(
    df: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.95,
    window: int = WINDOW,
    block: int = BLOCK,
    chunk: int = CHUNK,
    miss: float = MISS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their cosine in double precision is at least ``threshold``. Equal vectors are taken
    together first. A first pass sorts by concatenated random hashes and compares each row with the next two, so
    that crowds of near copies become one class early; the further passes compare whole windows, but only
    rows of different classes, and candidates whose hashes agree enough are verified. Where more rows than a window share the
    leading hashes on which a pair at the threshold agrees in one of the passes, the run is then compared wholly, so a pair
    is missed with a chance of about ``miss`` however the rows crowd. The links inside the resulting classes are counted
    exactly, chunk by chunk. NULL, empty, zero and non-finite vectors, and rows without an id, link
    with nothing. Vectors of different lengths never link. Repeated rows count as other vectors, and so do unlike vectors
    under one id. An empty table gives an empty table. Other columns of ``df`` are not read.
    """
    hashes = lambda v: [F.xxhash64(v).alias("_h"), F.xxhash64(F.lit(1), v).alias("_k")]
    rows = usable_rows(df, id_column, vector).select("_id", "_v", *hashes("_v"))
    grouped = rows.groupBy("_h", "_k").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.first("_v").alias("_v"))
    grouped = materialize(grouped, "grouped")
    # Numbers follow the ids, so the smallest number of a component belongs to its smallest id.
    vectors = materialize(grouped.orderBy("_first", "_h", "_k").withColumn("_id", F.monotonically_increasing_id()), "vectors")
    release(grouped)
    total = vectors.count()
    angle = acos(min(1.0, threshold)) / pi
    # Bits that a pair at the threshold differs in, and four standard deviations.
    most_bits = ceil(BITS * angle + 4 * (BITS * angle * (1 - angle)) ** 0.5)

    first = materialize(_codes(vectors, range(1), seed), "codes")
    links = _verified(_window_pairs(first.withColumn("_class", F.col("_id")), 2, block, most_bits), vectors, threshold)
    links = materialize(tied_to_smallest(links, "home"), "links")
    roots = _roots(links)
    depth = _measured_depth(_classed(first, roots), total, threshold, window, miss)
    codes = materialize(_codes(vectors, range(1, passes_needed(depth, threshold, miss) + 1), seed), "codes")
    release(first)
    more = _verified(_window_pairs(_classed(codes, roots), window, block, most_bits), vectors, threshold)
    links = materialize(links.union(tied_to_smallest(more, "home")), "links")
    roots = _roots(links)
    last = _run_links(_classed(codes, roots), vectors, depth, threshold, window, chunk)
    release(codes)
    if last is not None and not last.isEmpty():
        roots = _roots(links.union(last))
    members = roots.join(vectors, "_id").select(F.col("root").alias("_class"), "_id", "_n", "_v")
    counted = roots.join(_class_links(members, threshold, chunk), "_id").select("_id", "root", "_links")
    counts = counted.join(vectors.select(F.col("_id").alias("root"), F.col("_first").alias("_class")), "root").drop("root")

    named = vectors.select("_h", "_k", "_first", "_id", "_n").join(counts, "_id", "left")
    own = F.coalesce("_links", F.lit(0)) + F.col("_n") - 1
    found = named.select("_h", "_k", own.alias("_links"), F.coalesce("_class", "_first").alias("_class"))
    key = F.col(f"`{id_column}`")
    used = F.col("_id").isNotNull() & F.col("_use")
    every = df.select(key.cast("bigint").alias("_id"), usable(F.col(f"`{vector}`")).alias("_use"), *hashes(F.col(f"`{vector}`")))
    every = every.select("_id", *[F.when(used, F.col(c)).alias(c) for c in ("_h", "_k")])
    joined = every.join(found, ["_h", "_k"], "left")
    component = F.coalesce("_class", "_id")
    return joined.select(
        F.col("_id").alias(id_column),
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )
