"""Status changes of a live stream, point by point, as arbitrary state of each key.

The window are the last ``width`` points of a key. A point's status can only change when a neighbour arrives or an earlier
one expires, so state are the window's points, in immutable chunks of a map, and their counts, in a map beside it. Each run of new
positions is compared once with the window as it arrives and once with the window it leaves; no lists of neighbours
are kept. Work per point is linear in the width, memory is the window and one run times the window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from farpoint.functions.status import OUTLIER, SAFE, UNSAFE
from farpoint.specs import Attr, OutlierParams, used_attrs
from farpoint.streaming.keyed import LATE

# Points of one entry of the state maps, and positions that are compared with the window at a time.
CHUNK, RUN = 1024, 64
# Changes of a key that are handed over at a time: a table of them costs the same whether it holds few rows or many.
OUT_ROWS = 8192
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATUS = np.array([SAFE, UNSAFE, OUTLIER], dtype=object)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def near_matrix(left: dict[str, np.ndarray], right: dict[str, np.ndarray], attrs: list[Attr], radius: float) -> np.ndarray:
    """Which points of ``left`` and ``right`` are within the radius; NULL, NaN and infinite values are near nothing."""
    total = np.zeros((len(next(iter(left.values()))), len(next(iter(right.values())))))
    with np.errstate(invalid="ignore", over="ignore"):
        for a in attrs:
            x, y = left[a.name][:, None], right[a.name][None, :]
            if a.numeric:
                total += np.where(np.isfinite(x) & np.isfinite(y), (x - y) ** 2, np.inf)
            else:
                total += (x != y) | (x == None) | (y == None)  # noqa: E711
        return np.sqrt(total) <= radius


def _status(succ: np.ndarray, prev: np.ndarray, k: int) -> np.ndarray:
    return np.where(succ >= k, 0, np.where(succ + prev >= k, 1, 2)).astype(np.int8)


class Window:
    """The last points of one key with their counts, advanced by runs of new points."""

    def __init__(self, attrs: list[Attr], width: int, params: OutlierParams, first: int, values: dict[str, np.ndarray], succ, prev):
        self.attrs, self.width, self.params = attrs, width, params
        self.first, self.values = first, values  # ``first`` is the position of the oldest point
        self.succ, self.prev = np.asarray(succ, dtype=np.int64), np.asarray(prev, dtype=np.int64)

    @property
    def end(self) -> int:
        return self.first + len(self.succ)

    def _part(self, start: int, stop: int) -> dict[str, np.ndarray]:
        return {c: v[max(start - self.first, 0) : max(stop - self.first, 0)] for c, v in self.values.items()}

    def advance(self, new: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Add points; the changes (seq, at_seq, succ, prev, status) that they and the expiries bring."""
        k, radius, begin = self.params.k, self.params.radius, self.end
        n = len(next(iter(new.values())))
        self.values = {c: np.concatenate([self.values[c], new[c]]) for c in self.values}
        self.succ, self.prev = (np.concatenate([x, np.zeros(n, dtype=np.int64)]) for x in (self.succ, self.prev))
        seqs, at = np.arange(self.first, self.end)[:, None], np.arange(begin, self.end)[None, :]
        arrivals = near_matrix(self.values, self._part(begin, self.end), self.attrs, radius)
        inside = (at >= seqs) & (at < seqs + self.width)
        d_succ = arrivals & (at > seqs) & inside
        # Earlier neighbours of the new points themselves, at their arrival.
        earlier = (arrivals & (seqs < at) & (seqs > at - self.width)).sum(axis=0)
        d_prev = np.zeros(d_succ.shape, dtype=np.int64)
        gone = np.arange(begin, self.end) - self.width
        there = gone >= self.first
        if there.any():
            left = self._part(gone[there][0], gone[there][-1] + 1)
            expired = near_matrix(self.values, left, self.attrs, radius) & (gone[there][None, :] < seqs) & (at > seqs)[:, there] & inside[:, there]
            d_prev[:, there] -= expired
        own = np.arange(n)
        d_prev[len(self.succ) - n + own, own] += earlier
        before = _status(self.succ, self.prev, k)
        before[len(self.succ) - n :] = -1
        moved = np.flatnonzero((d_succ.any(axis=1)) | (d_prev != 0).any(axis=1) | (before < 0))
        succ = self.succ[moved, None] + d_succ[moved].cumsum(axis=1)
        prev = self.prev[moved, None] + d_prev[moved].cumsum(axis=1)
        status = _status(succ, prev, k)
        # A point has no status before it arrives.
        status[at < seqs[moved]] = -1
        former = np.concatenate([before[moved][:, None], status[:, :-1]], axis=1)
        row, column = np.nonzero((status != former) & inside[moved])
        self.succ[moved], self.prev[moved] = succ[:, -1], prev[:, -1]
        out = {
            "seq": seqs[moved[row], 0], "at_seq": at[0, column], "succ": succ[row, column], "prev": prev[row, column],
            "status": _STATUS[status[row, column]],
        }
        drop = max(0, self.end - self.width - self.first)
        self.first += drop
        self.values = {c: v[drop:] for c, v in self.values.items()}
        self.succ, self.prev = self.succ[drop:], self.prev[drop:]
        return out


class _Changes(StatefulProcessor):
    def __init__(self, key: str, order: list[str], attrs: list[Attr], width: int, params: OutlierParams, types: dict, idle_ms: int | None):
        self.key, self.order, self.attrs, self.width, self.params = key, order, attrs, width, params
        self.types, self.idle_ms = types, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        stored = lambda c: T.LongType() if isinstance(self.types[c], _TIMES) else self.types[c]
        self.handle = handle
        self.head = handle.getValueState("head", T.StructType([T.StructField("total", T.LongType()), *[T.StructField(c, stored(c)) for c in self.order]]))
        chunk = T.StructType([T.StructField("chunk", T.LongType())])
        columns = [T.StructField(a.name, T.ArrayType(T.DoubleType() if a.numeric else self.types[a.name])) for a in self.attrs]
        self.points = handle.getMapState("points", chunk, T.StructType(columns))
        counts = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("succ", "prev")]
        self.counts = handle.getMapState("counts", chunk, T.StructType(counts))

    def _restore(self, total: int) -> Window:
        first = max(total - self.width, 0) + 1
        columns, counts = {a.name: [] for a in self.attrs}, [[], []]
        for chunk in range((first - 1) // CHUNK, (total - 1) // CHUNK + 1) if total else ():
            skip = max(first - 1 - chunk * CHUNK, 0)
            for name, values in zip(columns, self.points.getValue((chunk,))):
                columns[name].extend(values[skip:])
            for held, values in zip(counts, self.counts.getValue((chunk,))):
                held.extend(values[skip:])
        return Window(self.attrs, self.width, self.params, first, {a.name: self._array(a, columns[a.name]) for a in self.attrs}, *counts)

    @staticmethod
    def _array(a: Attr, values: list) -> np.ndarray:
        if a.numeric:
            return np.array([np.nan if v is None else v for v in values], dtype="float64")
        out = np.empty(len(values), dtype=object)
        out[:] = [None if v is None or v != v else v for v in values]
        return out

    def _store(self, window: Window, total: int, old_total: int) -> None:
        """Write counts of all kept chunks, and points of chunks that got new ones; drop chunks that left the window."""
        for chunk in range((window.first - 1) // CHUNK, (total - 1) // CHUNK + 1):
            start = max(chunk * CHUNK + 1, window.first)
            stop = min((chunk + 1) * CHUNK, total) + 1
            # The first chunk keeps its places, so that it can be cut by position later.
            pad = [0] * (start - chunk * CHUNK - 1)
            part = slice(start - window.first, stop - window.first)
            self.counts.updateValue((chunk,), tuple(pad + x[part].tolist() for x in (window.succ, window.prev)))
            if stop - 1 > old_total:
                none = [None] * len(pad)
                self.points.updateValue((chunk,), tuple(none + window.values[a.name][part].tolist() for a in self.attrs))
        for chunk in range(max(old_total - self.width, 0) // CHUNK, (window.first - 1) // CHUNK):
            for state in (self.points, self.counts):
                if state.containsKey((chunk,)):
                    state.removeKey((chunk,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        key = None if pd.isna(new[self.key].iloc[0]) else new[self.key].iloc[0]
        for c in self.order:
            if isinstance(self.types[c], _TIMES):
                new[c] = new[c].astype("datetime64[us]").astype("int64")
        new = new.sort_values(self.order, ignore_index=True)
        total, *last = self.head.get() or (0,)
        if total:
            after = np.array([tuple(r) > tuple(last) for r in new[self.order].itertuples(index=False)], dtype=bool)
            if not after.all():
                nothing = [None] * int((~after).sum())
                yield self._rows(key, {**{c: nothing for c in ("seq", "at_seq", "succ", "prev")}, "status": [LATE] * len(nothing)})
                new = new[after]
        if len(new):
            window = self._restore(total)
            values = {a.name: self._array(a, new[a.name].tolist()) for a in self.attrs}
            held, rows_held = [], 0
            for start in range(0, len(new), RUN):
                run = slice(start, start + RUN)
                held.append(window.advance({c: v[run] for c, v in values.items()}))
                rows_held += len(held[-1]["status"])
                if rows_held >= OUT_ROWS or start + RUN >= len(new):
                    yield self._rows(key, {c: np.concatenate([part[c] for part in held]) for c in held[0]})
                    held, rows_held = [], 0
            self._store(window, total + len(new), total)
            tail = new[self.order].iloc[-1]
            self.head.update((total + len(new), *[v.item() if hasattr(v, "item") else v for v in tail]))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The key was idle: forget it."""
        for state in (self.head, self.points, self.counts):
            state.clear()
        yield self._rows(None, {c: [] for c in ("seq", "at_seq", "succ", "prev", "status")})

    def _rows(self, key, columns: dict) -> pd.DataFrame:
        n = len(columns["status"])
        return pd.DataFrame({self.key: pd.Series([key] * n, dtype=object), **{c: pd.Series(list(v), dtype=object) for c, v in columns.items()}})

    def close(self) -> None:
        pass


def stream_status_changes(
    stream: DataFrame,
    key: str,
    order: Sequence[str],
    attrs: list[Attr],
    width: int,
    params: OutlierParams,
    idle_ms: int | None = None,
) -> DataFrame:
    """Each status change of each point in the window of the last ``width`` points of its key, once, as it happens.

    Rows are (key, seq, at_seq, succ, prev, status): point ``seq`` has the status from position ``at_seq`` on. Rows are
    ordered inside a micro-batch; a row not after the last one of its key is returned with the status ``LATE`` and nothing
    else. NULL is a key of its own. A key without rows for ``idle_ms`` is forgotten and starts anew. One task handles one key. Start the
    query inside :func:`rocksdb_state`.
    """
    attrs = used_attrs(attrs)
    types = {f.name: f.dataType for f in stream.schema.fields}
    output = T.StructType(
        [T.StructField(key, types[key]), *[T.StructField(c, T.LongType()) for c in ("seq", "at_seq", "succ", "prev")], T.StructField("status", T.StringType())]
    )
    columns = list(dict.fromkeys([key, *order, *[a.name for a in attrs]]))
    processor = _Changes(key, list(order), attrs, width, params, types, idle_ms)
    # State is kept by a name of the key that is never NULL.
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit(""))
    return stream.select(*columns, name.alias("_name")).groupBy("_name").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="none" if idle_ms is None else "processingTime"
    )


class rocksdb_state:
    """Queries started in this context keep their state in RocksDB, which arbitrary state needs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_):
        self.spark.conf.unset(PROVIDER) if self.before is None else self.spark.conf.set(PROVIDER, self.before)
