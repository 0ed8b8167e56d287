import random

import pytest

from farpoint import Attr, OutlierParams, WindowSpec
from farpoint.operators.evidence import status_timeline, window_status
from farpoint.operators.numbering import number_rows
from farpoint.streaming.changes import CHUNK, RUN, Window, rocksdb_state, stream_status_changes
from farpoint.streaming.keyed import stream_outliers_keyed
from farpoint.streaming.windows import StreamJob

ATTRS = [Attr("v"), Attr("t", "nominal", "String")]
SPEC, PARAMS = WindowSpec(12, 4), OutlierParams(1.0, 2)
SCHEMA = "u int, at bigint, v double, t string"


def rows(n, seed):
    r = random.Random(seed)
    value = lambda: r.choice([None, float("nan"), float("inf")]) if r.random() < 0.1 else r.randint(0, 16) / 2
    return [(r.choice([0, None]) if r.random() < 0.8 else r.randint(1, 3), i, value(), r.choice(["a", "b", None])) for i in range(n)]


def batches(data, cuts):
    edges = [0, *cuts, len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def feed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def in_batch(spark, data, key):
    numbered = number_rows(spark.createDataFrame(data, SCHEMA), ["at"], key)
    return {tuple(r) for r in window_status(numbered, SPEC, ATTRS, PARAMS, key, ["at"]).collect()}


@pytest.mark.parametrize("cuts,key", [([5, 31], []), ([30], ["u"]), ([7, 20, 44], ["u"])])
def test_stream_equals_batch(spark, tmp_path, cuts, key):
    data = rows(50, 2)
    job = StreamJob(SPEC, PARAMS, ATTRS, ["at"], str(tmp_path / "job"), key, ["at"])
    job.start(feed(spark, str(tmp_path / "in"), batches(data, cuts))).awaitTermination()
    got = [tuple(r) for r in job.read(spark).select(*key, "window_id", "seq", "at", "succ", "prev", "status").collect()]
    assert len(got) == len(set(got)) and set(got) == in_batch(spark, data, key)
    assert job.read(spark, "late").count() == 0


def test_late_rows_go_aside_and_a_batch_may_run_twice(spark, tmp_path):
    data = rows(40, 3)
    late = [(0, 7, 99.0, "a")]
    job = StreamJob(SPEC, PARAMS, ATTRS, ["at"], str(tmp_path / "job"), identity=["at"])
    empty, first, second = (spark.createDataFrame(part, SCHEMA) for part in ([], data[:22], data[22:] + late))
    job.process(empty, 0)
    job.process(first, 1)
    job.process(second, 2)
    job.process(second, 2)  # as after a failure
    got = [tuple(r) for r in job.read(spark).select("window_id", "seq", "at", "succ", "prev", "status").collect()]
    assert len(got) == len(set(got)) and set(got) == in_batch(spark, data, [])
    assert [r.v for r in job.read(spark, "late").collect()] == [99.0]


def test_a_batch_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    job = StreamJob(SPEC, PARAMS, ATTRS, ["at"], str(tmp_path / "job"), ["u"], ["at"])
    data = [(i % 5 or None, i, float(i % 7), "a") for i in range(60)]
    first = spark.createDataFrame(data, SCHEMA)
    job.process(first, 0)
    job.process(spark.createDataFrame([(2, 100 + i, float(i), "a") for i in range(20)], SCHEMA), 1)
    bucket = {r.u: r.b for r in first.select("u", job._bucket().alias("b")).distinct().collect()}
    assert len(set(bucket.values())) > 1
    assert {b for b in bucket.values() if 1 in job.versions(spark, b)} == {bucket[2]}
    tail, older = job._tail(spark.createDataFrame([(2, 200, 0.0, "a")], SCHEMA), 2)
    assert older == {bucket[2]: [0, 1]} and all(f"_bucket={bucket[2]}/_batch=1" in f for f in tail.inputFiles())
    got = {tuple(r) for r in job.read(spark).select("u", "window_id", "seq", "at", "succ", "prev", "status").collect()}
    everything = data + [(2, 100 + i, float(i), "a") for i in range(20)]
    assert got == in_batch(spark, everything, ["u"])


def test_keyed_state_equals_batch(spark, tmp_path):
    data = rows(60, 4)
    stream = feed(spark, str(tmp_path / "in"), batches(data, [13, 45]))
    status = stream_outliers_keyed(stream, "u", ["at"], ATTRS, SPEC, PARAMS, ["at"])
    out = str(tmp_path / "out")
    writer = status.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.schema(status.schema).parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == in_batch(spark, data, ["u"])


def test_points_from_a_growing_csv_folder(spark, tmp_path):
    from farpoint.sources.points import stream_points, to_points

    folder = tmp_path / "csv"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_text(f"a,b\n{i},1.5\n{i + 10},oops\n")
    good, bad = to_points(stream_points(spark, str(folder), ["a", "b"]), ["a", "b"])
    for name, df in (("good_points", good), ("bad_points", bad)):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.a for r in spark.table("good_points").collect()) == [0.0, 1.0]
    assert sorted(r.a for r in spark.table("bad_points").collect()) == ["10", "11"]


@pytest.mark.parametrize(("width", "cuts"), [(12, [13, 45, 46]), (1, [30]), (40, [5])])
def test_status_changes_equal_the_timeline(spark, tmp_path, width, cuts):
    data = rows(90, 8)
    late = [(0, 3, 1.0, "a")]
    changes = stream_status_changes(feed(spark, str(tmp_path / "in"), [*batches(data, cuts), late]), "u", ["at"], ATTRS, width, PARAMS)
    out = str(tmp_path / "out")
    writer = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    with rocksdb_state(spark):
        writer.trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.schema(changes.schema).parquet(out).collect()]
    numbered = number_rows(spark.createDataFrame(data, SCHEMA), ["at"], ["u"])
    want = {tuple(r) for r in status_timeline(numbered, width, ATTRS, PARAMS, ["u"]).collect()}
    assert len(got) == len(set(got)) and set(got) == want | {(0, None, None, None, None, "Late")}


def test_a_wide_window_of_one_key_needs_little_memory():
    """A window of many runs and chunks against counting anew at every position."""
    import numpy as np

    r = np.random.default_rng(3)
    n, width, params = 3 * CHUNK, 2 * CHUNK + 7, OutlierParams(0.004, 3)
    v = r.random(n)
    window = Window([Attr("v")], width, params, 1, {"v": np.zeros(0)}, [], [])
    got = [[], [], [], [], []]
    for start in range(0, n, RUN):
        for held, x in zip(got, window.advance({"v": v[start : start + RUN]}).values()):
            held.extend(x.tolist())
    changes = sorted(zip(*got))
    assert len(window.succ) == width and window.end == n + 1
    near = np.abs(v[:, None] - v[None, :]) <= 0.004
    for p in r.integers(0, n, 40):
        mine, was = [c for c in changes if c[0] == p + 1], None
        for at in range(p, min(n, p + width)):
            succ, prev = near[p, p + 1 : at + 1].sum(), near[p, max(0, at - width + 1) : p].sum()
            status = "Safe" if succ >= 3 else "Unsafe" if succ + prev >= 3 else "Outlier"
            if status != was:
                assert mine.pop(0) == (p + 1, at + 1, succ, prev, status)
            was = status
        assert not mine
