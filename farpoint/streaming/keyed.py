"""Continuous detection for many independent streams, with the points of a window as keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from farpoint.functions.status import OUTLIER, SAFE, UNSAFE
from farpoint.specs import Attr, OutlierParams, WindowSpec, used_attrs

# Status of a row that came after a later one of its key; it is in no window.
LATE = "Late"


# Pairs of points of windows that are compared at a time.
PAIRS = 1 << 20
# Groups of keys. A call of a group costs some milliseconds whatever its rows, so many keys share one; more groups keep the state of each small.
KEY_GROUPS = 1 << 12


def _near(points: dict[str, np.ndarray], at: np.ndarray, attrs: list[Attr], radius: float) -> np.ndarray:
    """Per window a matrix of the pairs within the radius; NULL, NaN and infinite values are near nothing.

    A row of ``at`` has the places of a window's points. Nominal values come as numbers, -1 if missing.
    """
    total = 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        for a in attrs:
            column = points[a.name][at]
            x, y = column[:, :, None], column[:, None, :]
            if a.numeric:
                known = np.isfinite(column)
                total = total + np.where(known[:, :, None] & known[:, None, :], (x - y) ** 2, np.inf)
            else:
                total = total + ((x != y) | (x < 0) | (y < 0)).astype("float64")
        near = np.sqrt(total) <= radius
    near &= ~np.eye(at.shape[1], dtype=bool)
    return near


def _measures(points: dict[str, np.ndarray], attrs: list[Attr]) -> dict[str, np.ndarray]:
    """Numbers as doubles, nominal values numbered, -1 if missing."""
    return {a.name: points[a.name].astype("float64") if a.numeric else pd.factorize(points[a.name])[0] for a in attrs}


def _plain(columns: list[np.ndarray]) -> bool:
    """Whether all columns are numbers or times without a missing value."""
    return all(c.dtype.kind in "iufM" for c in columns) and not any(pd.isna(c).any() for c in columns if c.dtype.kind in "fM")


def _in_order(points: dict[str, np.ndarray], code: np.ndarray, order: Sequence[str]) -> np.ndarray:
    """Places of the points by key and order."""
    columns = [points[c] for c in order]
    if _plain(columns):
        return np.lexsort([*columns[::-1], code])
    return pd.DataFrame({**{f"_{i}": c for i, c in enumerate(columns)}, "_code": code}).sort_values(["_code", *[f"_{i}" for i in range(len(columns))]]).index.to_numpy()


def _after(columns: list[np.ndarray], last: list[np.ndarray]) -> np.ndarray:
    """Which rows come after those beside them, by one column after the other."""
    if not _plain(columns + last):
        rows = [pd.DataFrame(dict(enumerate(side))).itertuples(index=False, name=None) for side in (columns, last)]
        return np.array([row > other for row, other in zip(*rows)], dtype=bool)
    after, equal = np.zeros(len(columns[0]), dtype=bool), np.ones(len(columns[0]), dtype=bool)
    for column, value in zip(columns, last):
        after |= equal & (column > value)
        equal &= column == value
    return after


def stream_outliers_keyed(
    stream: DataFrame,
    key: str,
    order: Sequence[str],
    attrs: list[Attr],
    spec: WindowSpec,
    params: OutlierParams,
    identity: Sequence[str] = (),
) -> DataFrame:
    """Status of every point in every full window of its key, as soon as the window is complete.

    State is the last window of points per key, so it is bounded by the width. Rows are ordered
    inside a micro-batch; a row not after the last one of its key from earlier batches is returned once with the status
    ``LATE`` and no window, number or counts. Keys are dealt to ``KEY_GROUPS`` groups, all windows of a group are judged together. One key is handled
    by one task, so use this for many keys. For a few large keys use ``StreamJob``, which splits a
    key over tasks.
    """
    attrs = used_attrs(attrs)
    kept = list(dict.fromkeys([*order, *identity, *[a.name for a in attrs]]))
    fields = {f.name: f.dataType for f in stream.schema.fields}
    times = [c for c in [key, *kept] if isinstance(fields[c], (T.TimestampType, T.TimestampNTZType))]
    stored = lambda c: T.ArrayType(T.LongType() if c in times else fields[c])
    state_schema = T.StructType(
        [T.StructField("_keys", stored(key)), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("_totals", "_counts")]]
        + [T.StructField(f"_p{i}", stored(c)) for i, c in enumerate(kept)]
    )
    output_schema = T.StructType(
        [T.StructField(key, fields[key]), T.StructField("window_id", T.LongType()), T.StructField("seq", T.LongType())]
        + [T.StructField(c, fields[c]) for c in identity]
        + [T.StructField(c, T.LongType()) for c in ("succ", "prev")]
        + [T.StructField("status", T.StringType())]
    )
    slide, panes, points_per_window = spec.slide, spec.panes, spec.points

    def restored(values: Sequence, name: str) -> np.ndarray:
        column = np.array(values)
        if name in times:
            return pd.to_datetime(column, unit="us").to_numpy()
        return column if column.dtype.kind in "ifb" else pd.Series(list(values)).to_numpy()

    def listed(column: np.ndarray, name: str) -> list:
        return (column.astype("datetime64[us]").astype("int64") if name in times else column).tolist()

    def judged(points: dict[str, np.ndarray], names: np.ndarray, of: np.ndarray, windows: np.ndarray, at: np.ndarray) -> Iterator[pd.DataFrame]:
        """Status of the points of the windows ``windows`` of the keys ``of``, which begin at the places ``at``.

        A window begins with a slide, so all have their slides at the same places.
        """
        measures, inside = _measures(points, attrs), np.arange(points_per_window)
        later = inside[None, :] // slide >= inside[:, None] // slide
        some = max(1, PAIRS // points_per_window**2)
        for start in range(0, len(windows), some):
            ids = windows[start : start + some]
            rows = at[start : start + some, None] + inside[None, :]
            near = _near(measures, rows, attrs, params.radius)
            succ, prev = (near & later).sum(axis=2).ravel(), (near & ~later).sum(axis=2).ravel()
            status = np.where(succ >= params.k, SAFE, np.where(succ + prev >= params.k, UNSAFE, OUTLIER)).astype(object)
            seqs = ((ids - panes + 1) * slide + 1)[:, None] + inside[None, :]
            yield pd.DataFrame(
                {key: np.repeat(names[of[start : start + some]], points_per_window), "window_id": np.repeat(ids, points_per_window),
                 "seq": seqs.ravel(), **{c: points[c][rows.ravel()] for c in identity}, "succ": succ, "prev": prev, "status": status}
            )

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        new = {c: np.concatenate([b[c].to_numpy() for b in parts]) for c in kept}
        # Rows without a key have a group of their own.
        mine = np.zeros(len(new[kept[0]]), dtype=np.int64) if group[1] else np.concatenate([b[key].to_numpy() for b in parts])
        known, old = mine[:0], {c: values[:0] for c, values in new.items()}
        totals = held = np.zeros(0, dtype=np.int64)
        if state.exists:
            keys, totals, held, *arrays = state.get
            known = np.zeros(len(keys), dtype=np.int64) if group[1] else restored(keys, key)
            totals, held = np.array(totals, dtype=np.int64), np.array(held, dtype=np.int64)
            old = {c: restored(a, c) for c, a in zip(kept, arrays)}
        # Old keys come first, so they keep their numbers.
        code, names = pd.factorize(np.concatenate([known, mine]), use_na_sentinel=False)
        code, names = code[len(known) :], np.full(len(names), None, dtype=object) if group[1] else np.asarray(names)
        totals, held = (np.append(x, np.zeros(len(names) - len(known), dtype=np.int64)) for x in (totals, held))
        at = _in_order(new, code, order)
        code, new = code[at], {c: values[at] for c, values in new.items()}
        judge = held[code] > 0
        if judge.any():
            last = (np.cumsum(held) - 1)[code[judge]]
            late = np.zeros(len(code), dtype=bool)
            late[judge] = ~_after([new[c][judge] for c in order], [old[c][last] for c in order])
            if late.any():
                nothing = lambda: np.full(int(late.sum()), None, dtype=object)
                yield pd.DataFrame(
                    {key: names[code[late]], "window_id": nothing(), "seq": nothing(), **{c: new[c][late] for c in identity},
                     "succ": nothing(), "prev": nothing(), "status": LATE}
                )
                code, new = code[~late], {c: values[~late] for c, values in new.items()}
        added = np.bincount(code, minlength=len(names))
        size = held + added
        at = np.argsort(np.concatenate([np.repeat(np.arange(len(names)), held), code]), kind="stable")
        points = {c: (np.concatenate([old[c], new[c]]) if len(code) and len(old[c]) else new[c] if len(code) else old[c])[at] for c in kept}
        begin, first, new_totals = np.cumsum(size) - size, totals - held + 1, totals + added
        lowest = np.maximum(totals // slide, panes - 1)
        count = np.maximum(new_totals // slide - lowest, 0)
        of = np.repeat(np.arange(len(names)), count)
        if len(of):
            windows = np.arange(len(of)) - (np.cumsum(count) - count)[of] + lowest[of]
            yield from judged(points, names, of, windows, (windows - panes + 1) * slide + 1 - first[of] + begin[of])
        needed = np.maximum(0, (new_totals // slide - panes + 1) * slide + 1 - first)
        needed = np.minimum(needed, np.maximum(0, size - 1))
        rest = np.arange(len(at)) - np.repeat(begin, size) >= np.repeat(needed, size)
        counts = (size - needed).tolist()
        keys = names.tolist() if group[1] else listed(names, key)
        state.update((keys, new_totals.tolist(), counts, *[listed(points[c][rest], c) for c in kept]))

    dealt = [F.pmod(F.xxhash64(key), F.lit(KEY_GROUPS)).alias("_group"), F.col(key).isNull().alias("_keyless")]
    return stream.select(key, *[c for c in kept if c != key], *dealt).groupBy("_group", "_keyless").applyInPandasWithState(
        update, output_schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )
