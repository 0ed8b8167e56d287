"""Continuous detection over count windows, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from farpoint.functions.status import classify
from farpoint.operators.evidence import SlideCounts, count_slides, counts_per_window, observed
from farpoint.operators.neighbors import block_pairs
from farpoint.operators.numbering import number_rows
from farpoint.operators.windows import full_slides, slide_of
from farpoint.session import delete_folder, materialize, release, subfolders
from farpoint.specs import Attr, OutlierParams, WindowSpec, used_attrs

_COUNTS = ArrayType(StructType([StructField("nb_slide", LongType()), StructField("_near", LongType())]))


@dataclass(frozen=True)
class StreamJob:
    """A detection job on a stream and the folder that holds its results and state.

    ``order`` must be unique per key. Rows are numbered in this order inside a micro-batch; a row
    that sorts before the last numbered row of its key is late and goes to a side output, because a
    count window cannot be opened again. NULL is a key of its own.

    State are the points that later windows hold and, with each of them, its neighbours per slide so far. It lies in
    buckets by hash of the key. A batch reads and rewrites only the buckets of its own keys, and only looks for pairs
    with a new point; what kept points already know of each other is not searched again.
    """

    spec: WindowSpec
    params: OutlierParams
    attrs: list[Attr]
    order: list[str]
    folder: str
    key: list[str] = field(default_factory=list)
    identity: list[str] = field(default_factory=list)
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        names = [a.name for a in used_attrs(self.attrs)]
        return list(dict.fromkeys([*self.key, *self.order, *self.identity, *names]))

    def path(self, part: str, batch: int) -> str:
        return f"{self.folder}/{part}/batch={batch}"

    def read(self, spark: SparkSession, part: str = "windows") -> DataFrame:
        """Everything written so far to ``windows`` or ``late``."""
        return spark.read.parquet(f"{self.folder}/{part}").drop("batch")

    # State -----------------------------------------------------------------------------------

    def _bucket(self):
        """Bucket of a row's key; a stream without keys has one."""
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def bucket_path(self, bucket: int, batch: int | None = None) -> str:
        path = f"{self.folder}/state/_bucket={bucket}"
        return path if batch is None else f"{path}/_batch={batch}"

    def versions(self, spark: SparkSession, bucket: int) -> list[int]:
        """Batches that have written the bucket and are still there, oldest first."""
        return sorted(int(name.split("=")[1]) for name in subfolders(spark, self.bucket_path(bucket)))

    def _tail(self, rows: DataFrame, batch_id: int) -> tuple[DataFrame | None, dict[int, list[int]]]:
        """Kept points of the keys' buckets as the batches before left them, and the versions of these buckets."""
        spark = rows.sparkSession
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()] if self.key else [0]
        older = {b: [v for v in self.versions(spark, b) if v < batch_id] for b in touched}
        paths = [self.bucket_path(b, vs[-1]) for b, vs in older.items() if vs]
        if not paths:
            return None, older
        schema = rows.select(*self.columns).schema.add("seq", "long").add("_counts", _COUNTS)
        return spark.read.schema(schema).parquet(*paths), older

    def _write_state(self, kept: DataFrame, batch_id: int) -> None:
        placed = kept.select(*self.columns, "seq", "_counts", self._bucket().alias("_bucket"), F.lit(batch_id).alias("_batch"))
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy("_bucket", "_batch")).parquet(f"{self.folder}/state")

    # One micro-batch -------------------------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Number the new rows, judge the windows they complete, and keep the points still needed.

        State and results are written per batch id and depend only on the state before, so a batch
        that is run again after a failure replaces its own output.
        """
        rows = batch.select(*self.columns)
        tail, older = self._tail(rows, batch_id)
        known = self._known(tail)

        last = F.coalesce(F.struct(*self.order) <= F.col("_last"), F.lit(False))
        marked = known(rows).withColumn("_late", last)
        marked.where("_late").select(*self.columns).write.mode("overwrite").parquet(self.path("late", batch_id))
        numbered = number_rows(marked.where("NOT _late").select(*self.columns), self.order, self.key)
        old, new = self._merge(numbered, tail, known)

        counts = self._counts(old, new, numbered.count() + (0 if tail is None else tail.count()))
        kept_counts = SlideCounts(materialize(counts.df, "counts"), counts.place, counts.point)
        status = observed(self._windows(kept_counts), f"batch_{batch_id}")
        status.write.mode("overwrite").parquet(self.path("windows", batch_id))
        self._write_state(self._kept(new if old is None else new.unionByName(old.drop("_counts")), kept_counts), batch_id)
        # The version before stays for a batch that runs again.
        for bucket, versions in older.items():
            for version in versions[:-1]:
                delete_folder(batch.sparkSession, self.bucket_path(bucket, version))
        release(kept_counts.df)
        release(numbered)

    def _same(self, left: str, right: str) -> list:
        return [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in self.key]

    def _known(self, tail: DataFrame | None) -> Callable[[DataFrame], DataFrame]:
        """A function that adds ``_seen`` (rows numbered so far) and ``_last`` (the last of them).

        A stream without keys has one value of each, which is read once; with keys they are joined.
        """
        order = F.struct(*self.order)
        if tail is None:
            nothing = {"_seen": F.lit(0).cast("bigint"), "_last": F.when(F.lit(False), order)}
            return lambda df: df.withColumns(nothing)
        per_key = tail.groupBy(*self.key).agg(F.max("seq").alias("_seen"), F.max(order).alias("_last"))
        if self.key:
            seen = F.coalesce("k._seen", F.lit(0).cast("bigint")).alias("_seen")
            return lambda df: df.alias("d").join(per_key.alias("k"), self._same("d", "k"), "left").select("d.*", seen, "k._last")
        # Read as text and cast back, so that no time zone of the driver gets in between.
        last = [F.col(f"_last.{c}").cast("string").alias(c) for c in self.order]
        row = per_key.select("_seen", *last).first()
        if row["_seen"] is None:
            return self._known(None)
        types = {c: tail.schema[c].dataType for c in self.order}
        values = {
            "_seen": F.lit(row["_seen"]).cast("bigint"),
            "_last": F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in self.order]),
        }
        return lambda df: df.withColumns(values)

    def _merge(
        self, numbered: DataFrame, tail: DataFrame | None, known: Callable[[DataFrame], DataFrame]
    ) -> tuple[DataFrame | None, DataFrame]:
        """Kept and new points with final positions, new totals and ``_seen``."""
        seen = F.col("_seen")
        fields = [*self.columns, "seq", "stream_rows", "_seen"]
        new = known(numbered).withColumns({"seq": F.col("seq") + seen, "stream_rows": F.col("stream_rows") + seen}).select(*fields)
        if tail is None:
            return None, new
        old = known(tail)
        if self.key:
            totals = numbered.groupBy(*self.key).agg(F.max("stream_rows").alias("_new"))
            old = old.alias("o").join(totals.alias("t"), self._same("o", "t"), "left").select("o.*", "t._new")
        else:
            old = old.withColumn("_new", F.lit(numbered.count()))
        old = old.withColumn("stream_rows", seen + F.coalesce("_new", F.lit(0).cast("bigint")))
        return old.select(*fields, "_counts"), new

    @property
    def _carried(self) -> list[str]:
        return [*[c for c in self.identity if c not in self.key], "_seen"]

    def _counts(self, old: DataFrame | None, new: DataFrame, rows: int) -> SlideCounts:
        """Counts per slide of kept and new points: what kept points have, and what pairs with a new point add.

        New points are searched for among kept and new ones, kept points among new ones only; which of them is
        meant is part of the join key. ``rows`` is the number of all points.
        """
        points = new.withColumn("_new", F.lit(True))
        probes = points
        place = [*self.key, "seq"]
        point = [*place, "slide_id", "stream_rows", *self._carried]
        if old is not None:
            kept = old.drop("_counts")
            points = points.unionByName(kept.withColumn("_new", F.lit(False)))
            probes = new.withColumn("_new", F.explode(F.array(F.lit(True), F.lit(False)))).unionByName(kept.withColumn("_new", F.lit(True)))
        pairs = block_pairs(points, self.spec, self.attrs, self.params.radius, [*self.key, "_new"], self._carried, probes=probes, rows=rows)
        counts = count_slides(pairs).df.select(*point, "nb_slide", "_near")
        if old is not None:
            had = old.withColumn("slide_id", slide_of("seq", self.spec)).select(*point, F.explode("_counts").alias("_c"))
            counts = counts.unionByName(had.select(*point, "_c.*"))
            counts = counts.groupBy(*point, "nb_slide").agg(F.sum("_near").alias("_near"))
        return SlideCounts(counts, place, point)

    def _windows(self, counts: SlideCounts) -> DataFrame:
        """Status of the points in the windows that the batch completes."""
        first_open = F.floor(F.col("_seen") / self.spec.slide)
        windows = counts_per_window(counts, self.spec).where(F.col("window_id") >= first_open)
        status = classify("succ", "prev", self.params.k).alias("status")
        return windows.select(*self.key, "window_id", "seq", *[c for c in self.identity if c not in self.key], "succ", "prev", status)

    def _kept(self, points: DataFrame, counts: SlideCounts) -> DataFrame:
        """Points of windows to come and the last one of each key, with their counts per slide."""
        oldest = full_slides(self.spec) - self.spec.panes + 1
        needed = (slide_of("seq", self.spec) >= oldest) | (F.col("seq") == F.col("stream_rows"))
        arrays = counts.df.where(needed).groupBy(*counts.place).agg(F.collect_list(F.struct("nb_slide", "_near")).alias("_counts"))
        same = [*self._same("p", "a"), F.col("p.seq") == F.col("a.seq")]
        return points.where(needed).alias("p").join(arrays.alias("a"), same).select("p.*", "a._counts")

    # The stream ------------------------------------------------------------------------------

    def start(self, stream: DataFrame, available_now: bool = True, **trigger: str) -> StreamingQuery:
        """Run on a stream; by default over all data there is, in as many batches as the source cuts."""
        writer = (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .queryName(f"outliers_{abs(hash(self.folder))}")
        )
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(**trigger)).start()
