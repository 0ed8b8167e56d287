"""Mixing sources to target weights under a maximum number of repetitions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.operators.numbering import number_rows, running_total
from farpoint.session import materialize

SEED = 20_240_817
MAX_EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words without ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def weights_in_turn(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with ``_weight``: the given weights in turn, by code point of the name, NULL last."""
    ordered = sources.withColumn("_last", F.col("_source").isNull()).withColumn("_name", F.coalesce("_source", F.lit("")))
    numbered = number_rows(ordered, ["_last", "_name"], seq="_seq", total="_sources")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return numbered.select(*sources.columns, turn[F.pmod(F.col("_seq") - 1, F.lit(len(weights))).cast("int")].alias("_weight"))


def water_fill(weighted: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``weighted`` (``_source``, ``_source_size``, ``_weight``) with ``_target``.

    The targets share the sum of all sizes by weight. A source stops at ``max_epochs`` times its size,
    and what it leaves is shared among the others by weight, until none is above. Sources are
    clamped in order of limit / weight, so running totals in that order tell for each source the share per
    weight that is left when all before it are clamped; it is clamped too if its limit is not above
    that. The totals are distributed, so sources may be many. A weight of zero gets a target of zero.
    """
    size, weight = F.col("_source_size").cast("double"), F.col("_weight")
    limit = size * F.lit(float(max_epochs))
    sources = weighted.withColumn("_limit", F.when(weight > 0, limit).otherwise(0.0))
    sources = sources.withColumn("_ratio", F.when(weight > 0, limit / weight).otherwise(F.lit(0.0)))
    sources = sources.withColumn("_nil", F.col("_source").isNull()).withColumn("_name", F.coalesce("_source", F.lit("")))
    order = ["_ratio", "_nil", "_name"]
    sources = running_total(sources, "_limit", order, [], "_limits")
    sources = materialize(running_total(sources, "_weight", order, [], "_weights"), "sources")
    total, weights = (sources.agg(F.sum(c).alias("x")).select("x").scalar() for c in ("_source_size", "_weight"))
    left = total - (F.col("_limits") - F.col("_limit"))
    share = left / (weights - (F.col("_weights") - weight))
    clamped = sources.where((F.col("_ratio") <= share) | (weight <= 0))
    gone = [clamped.agg(F.coalesce(F.sum(c), F.lit(0.0)).alias("x")).select("x").scalar() for c in ("_limit", "_weight")]
    level = (total - gone[0]) / F.nullif(weights - gone[1], F.lit(0.0))
    target = F.when((F.col("_ratio") <= share) | (weight <= 0), F.col("_limit")).otherwise(weight * level)
    return sources.select(*weighted.columns, F.coalesce(target, F.lit(0.0)).alias("_target"))


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size come near the gap: as many as fit, the largest first, and one that is a little too large if nearer."""
    pdf = pdf.sort_values("_size", ascending=False)
    gap, taken, above = float(pdf["_gap"].iloc[0]), {}, None
    for size, n in zip(pdf["_size"].tolist(), pdf["_n"].tolist()):
        fit = min(n, int(gap // size))
        gap -= fit * size
        taken[size] = fit
        if fit < n:
            above = size
    if above and above - gap < gap:
        taken[above] += 1
    return pd.DataFrame({"_source": [pdf["_source"].iloc[0]] * len(taken), "_of": pd.Series(taken.keys(), dtype="int64"), "_take": pd.Series(taken.values(), dtype="int64")})


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: its id, source, ``_size`` in words, ``_source_size``, ``_target`` of its source and ``_copies``.

    A source whose target is e times its size takes every document floor(e) times. The rest is made up
    of documents in seeded hash order as long as they fit. What is then missing is filled by further documents,
    the largest sizes that fit first and in hash order within a size, and by one that is a little too large if that is
    nearer than none; the smallest document that is left would then come no nearer. Sums and numbers in hash order are
    distributed, so a source of any size spreads over many tasks; a task of the filling sees distinct sizes only. Reruns agree. NULL is a source of its own and
    sorts last; NULL text has size 0; a document without words is taken as the whole repetitions say. Rows that
    share an id are documents of their own. An empty table gives an empty table. ``carry`` columns are kept.
    """
    key = F.col(f"`{id_column}`")
    kept = [F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)]
    sized = docs.select(key.alias("_id"), F.col(f"`{source}`").alias("_source"), word_count(F.col(f"`{text}`")).alias("_size"), *kept)
    sized = materialize(sized.withColumn("_hash", F.xxhash64(F.lit(seed), "_id", "_size")), "sized")
    sources = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    targets = water_fill(weights_in_turn(sources, weights), max_epochs)
    epochs = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    targets = targets.withColumn("_whole", F.floor(epochs))
    targets = materialize(targets.withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_source_size")), "targets")

    def with_source(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        return rows.alias("d").join(table.alias("s"), F.col("d._source").eqNullSafe(F.col("s._source")), "left").select("d.*", *[f"s.{c}" for c in columns])

    summed = running_total(sized, "_size", ["_hash", "_id", "_size"], ["_source"], "_sum")
    summed = materialize(with_source(summed, targets, "_source_size", "_target", "_whole", "_rest"), "summed")
    fits = F.col("_sum") <= F.col("_rest")
    reached = summed.where(fits).groupBy("_source").agg(F.max("_sum").alias("_reached"))
    gaps = with_source(targets.select("_source", "_rest"), reached, "_reached")
    gaps = materialize(gaps.select("_source", (F.col("_rest") - F.coalesce("_reached", F.lit(0))).alias("_gap")), "gaps")
    others = with_source(summed.where(~fits & (F.col("_size") > 0)), gaps, "_gap").where("_size < 2 * _gap")
    others = number_rows(others.select("_source", "_size", "_sum", "_gap"), ["_sum"], ["_source", "_size"], "_nth", "_n")
    sizes = others.groupBy("_source", "_size").agg(F.max("_n").alias("_n"), F.first("_gap").alias("_gap"))
    filled = sizes.groupBy("_source").applyInPandas(_fill, f"_source {dict(sized.dtypes)['_source']}, _of bigint, _take bigint")
    filled = materialize(filled, "filled")
    same = F.col("d._source").eqNullSafe(F.col("c._source")) & (F.col("d._size") == F.col("c._of")) & (F.col("d._nth") <= F.col("c._take"))
    chosen = others.alias("d").join(filled.alias("c"), same).select("d._source", F.col("d._sum").alias("_chosen"))
    same = F.col("d._source").eqNullSafe(F.col("c._source")) & (F.col("d._sum") == F.col("c._chosen")) & (F.col("d._size") > 0)
    chosen = summed.alias("d").join(chosen.alias("c"), same, "left").select("d.*", "c._chosen")
    extra = fits | F.col("_chosen").isNotNull()
    copies = (F.col("_whole") + F.when(extra & (F.col("_rest") > 0), 1).otherwise(0)).cast("bigint")
    named = [F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)]
    return chosen.select(
        F.col("_id").alias(id_column), F.col("_source").alias(source), "_size", "_source_size", "_target", copies.alias("_copies"), *named
    )
