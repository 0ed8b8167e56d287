"""Dense numbering of an ordered table and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.session import materialize

# Offsets that are sent to all tasks: counted first, and a few MB at most.
BROADCAST_ROWS = 100_000

_PART, _INDEX, _COUNT, _FIRST, _BEFORE = "_part", "_index", "_count", "_first", "_before"


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    key: Sequence[str] = (),
    seq: str = "seq",
    total: str = "stream_rows",
) -> DataFrame:
    """Add ``seq`` = 1..N in order within each key, and ``total`` = N.

    ``order_by`` must be unique within a key; rows whose key is NULL are a key of their own. The table is range-partitioned by (key, order), so a
    key of any size spreads over many tasks, and written once, since a second range sampling could
    draw other bounds. Row numbers are then the position inside a partition plus the row count of
    the partitions before it, which needs only a count per partition.
    """
    keys = list(key)
    if {seq, total} & set(df.columns):
        raise ValueError(f"the table has a column {seq} or {total} already; name others")
    stored = _ranged_copy(df, keys, order_by)
    groups = stored.groupBy(*keys, _PART).agg(F.count("*").alias(_COUNT), F.min(_INDEX).alias(_FIRST))
    if keys:
        # One row per key and partition, worked out once. If they are few they go to all tasks; else
        # the join is on (key, partition), which splits a hot key by partition.
        offsets = materialize(_offsets(groups, keys, total), "offsets")
        few = offsets.count() <= BROADCAST_ROWS
        same = [F.col(f"s.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in [*keys, _PART]]
        joined = stored.alias("s").join((F.broadcast(offsets) if few else offsets).alias("o"), same)
        number = F.col(_BEFORE) + F.col(_INDEX) - F.col(f"o.{_FIRST}") + 1
        return joined.select(*[F.col(f"s.`{c}`") for c in df.columns], number.alias(seq), F.col(f"o.`{total}`"))
    # One count per partition of the written table, however large the table is.
    counts = {row[_PART]: row[_COUNT] for row in groups.collect()}
    before = [0]
    for part in range(max(counts, default=0) + 1):
        before.append(before[-1] + counts.get(part, 0))
    offset = F.expr(f"array({', '.join(f'{n}L' for n in before)})")[F.col(_PART)]
    return stored.select(*df.columns, (offset + F.col(_INDEX) + 1).alias(seq), F.lit(before[-1]).cast("bigint").alias(total))


def _ranged_copy(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The table range-partitioned and sorted, written with partition number and position in it."""
    ranged = df.repartitionByRange(*key, *order_by).sortWithinPartitions(*key, *order_by)
    row_in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.select("*", F.spark_partition_id().alias(_PART), row_in_partition.alias(_INDEX))
    return materialize(numbered, "numbered")


def running_total(df: DataFrame, value: str, order_by: Sequence[str], key: Sequence[str], name: str) -> DataFrame:
    """Add ``name`` = sum of ``value`` up to and including the row, in order within each key.

    Sums run inside the partitions of the sorted copy and start from the sum of the partitions
    before, so a key of any size spreads over many tasks.
    """
    keys = list(key)
    stored = _ranged_copy(df, keys, order_by)
    in_order = Window.partitionBy(*keys).orderBy(_PART)
    sums = stored.groupBy(*keys, _PART).agg(F.sum(value).alias(_COUNT))
    before = (F.sum(_COUNT).over(in_order) - F.col(_COUNT)).alias(_BEFORE)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*keys, _PART]]
    joined = stored.alias("s").join(sums.select(*keys, _PART, before).alias("o"), same).select("s.*", _BEFORE)
    local = Window.partitionBy(*keys, _PART).orderBy(_INDEX).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(name, F.sum(value).over(local) + F.col(_BEFORE)).select(*df.columns, name)


def _offsets(groups: DataFrame, keys: list[str], total: str) -> DataFrame:
    in_order = Window.partitionBy(*keys).orderBy(_PART)
    return groups.select(
        *keys,
        _PART,
        _FIRST,
        (F.sum(_COUNT).over(in_order) - F.col(_COUNT)).alias(_BEFORE),
        F.sum(_COUNT).over(Window.partitionBy(*keys)).alias(total),
    )


def split_at(df: DataFrame, order_by: Sequence[str], k: int) -> DataFrame:
    """Mark each row ``left``, ``kth`` or ``right`` of the k-th row in order.

    If there is no k-th row, all rows are to the right (k <= 0) or to the left (k > N).
    """
    part = F.when(F.col("_seq") < k, "left").when(F.col("_seq") == k, "kth").otherwise("right")
    numbered = number_rows(df, order_by, seq="_seq", total="_total")
    return numbered.select(part.alias("part"), *df.columns)


def first_row(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """First row in order (a distributed top-1, not a full sort)."""
    return df.orderBy(*order_by).limit(1)


def last_row(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Last row in order."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(1)


def drop_first(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """All rows but the first in order: one aggregate and a filter, no sort."""
    order = F.struct(*order_by)
    first = df.agg(F.min(order).alias("_first")).select("_first")
    return df.where(order != first.scalar())


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
