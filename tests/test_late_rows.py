from collections import Counter

from farpoint.streaming.keyed import LATE, stream_outliers_keyed
from tests.test_streaming import ATTRS, PARAMS, SPEC, feed, in_batch, rows


def test_keyed_state_returns_late_rows(spark, tmp_path):
    data = rows(60, 4)
    late = [(0, 1, 99.0, "a"), (0, 1, 98.0, "b"), (1, -5, 97.0, "a")]
    stream = feed(spark, str(tmp_path / "in"), [data[:45], data[45:] + late])
    status = stream_outliers_keyed(stream, "u", ["at"], ATTRS, SPEC, PARAMS, ["at", "v"])
    out = str(tmp_path / "out")
    writer = status.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(status.schema).parquet(out).collect()
    aside = [tuple(r) for r in got if r.status == LATE]
    assert Counter(aside) == Counter((u, None, None, at, v, None, None, LATE) for u, at, v, _ in late)
    in_windows = [(r.u, r.window_id, r.seq, r["at"], r.succ, r.prev, r.status) for r in got if r.status != LATE]
    assert len(in_windows) == len(set(in_windows)) and set(in_windows) == in_batch(spark, data, ["u"])
