"""Reference answers of the named queries in plain SQL (DuckDB), written independently of the plans."""

from __future__ import annotations

from math import sqrt

from farpoint.plans import queries as q
from farpoint.plans import tables as t


def _dist(*numeric: str, nominal: tuple[str, ...] = ()) -> str:
    terms = [f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in numeric]
    terms += [f"CASE WHEN a.{c}=b.{c} THEN 0.0 ELSE 1.0 END" for c in nominal]
    return "sqrt(" + "+".join(terms) + ")"


EVENT_DIST = _dist("value", nominal=("event_type",))


def _points(slide: int, key: str = "") -> str:
    part = f"PARTITION BY {key}" if key else ""
    return f"""
    p AS (
      SELECT *, (seq - 1) // {slide} AS sl FROM (
        SELECT event_id, user_id, event_type, value,
               row_number() OVER ({part} ORDER BY ts, event_id) AS seq,
               count(*) OVER ({part}) AS n
        FROM events) numbered)"""


def _neighbors(slide: int, panes: int, radius: float, key: str = "") -> str:
    same = f"a.{key} = b.{key} AND " if key else ""
    return f"""
    nb AS (
      SELECT {f'a.{key} AS {key},' if key else ''} a.seq, a.sl, b.seq AS nb_seq, b.sl AS nb_sl, {EVENT_DIST} AS dist
      FROM p a JOIN p b ON {same} b.seq BETWEEN a.seq - {slide * panes} AND a.seq + {slide * panes}
       AND b.seq <> a.seq AND abs(b.sl - a.sl) < {panes} AND {EVENT_DIST} <= {radius})"""


STATUS = "CASE WHEN succ >= {k} THEN 'Safe' WHEN succ + prev >= {k} THEN 'Unsafe' ELSE 'Outlier' END"


def _status(spec, params, key: str = "", carry: str = "event_id, user_id") -> str:
    s, m = spec.slide, spec.panes
    k = f"{key}, " if key else ""
    on_key = f"nb.{key} = w.{key} AND " if key else ""
    return f"""
    {_points(s, key)}, {_neighbors(s, m, params.radius, key)},
    w AS (SELECT p.*, sl + j AS window_id FROM p, range({m}) r(j) WHERE sl + j >= {m - 1} AND sl + j < n // {s}),
    c AS (
      SELECT w.window_id, w.seq, w.event_id, w.user_id, w.sl,
             count(nb_sl) FILTER (WHERE nb_sl >= w.sl) AS succ,
             count(nb_sl) FILTER (WHERE nb_sl < w.sl) AS prev
      FROM w LEFT JOIN nb ON {on_key} nb.seq = w.seq AND nb_sl BETWEEN window_id - {m - 1} AND window_id
      GROUP BY ALL),
    st AS (SELECT *, {STATUS.format(k=params.k)} AS status FROM c)"""


def _window_sql(select: str, spec=q.SPEC, params=q.PARAMS, key: str = "", more: str = "") -> str:
    return f"WITH {_status(spec, params, key)}{more} {select}"


def _orders_boxes(more: str = "") -> str:
    return f"""WITH b AS (
      SELECT id, x AS "xMin", y AS "yMin", x + 1 + id % 7 AS "xMax", y + 1 + c % 11 AS "yMax" FROM (
        SELECT o_orderkey AS id, o_custkey AS c, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS x,
               CAST(floor(o_totalprice / 100) AS BIGINT) AS y FROM orders) o){more}"""


BOX_MEET = """a."xMax" >= b."xMin" AND b."xMax" >= a."xMin" AND a."yMax" >= b."yMin" AND b."yMax" >= a."yMin" """
BOX_PAIRS = f"""SELECT a.id AS id, b.id AS hit FROM b a JOIN b ON a.id <> b.id AND {BOX_MEET}"""


def _kd(select: str, levels: int = 8) -> str:
    axes = ("xMin", "yMin", "xMax", "yMax")
    steps = [", l0 AS (SELECT *, 1::BIGINT AS leaf_id FROM b)"]
    for i in range(levels):
        steps.append(f""", l{i + 1} AS (
          SELECT id, "xMin", "yMin", "xMax", "yMax",
                 CASE WHEN n <= {q.LEAF_CUTOFF} THEN leaf_id WHEN rn > (n + 1) // 2 THEN leaf_id * 2 + 1 ELSE leaf_id * 2 END AS leaf_id
          FROM (SELECT *, count(*) OVER (PARTITION BY leaf_id) AS n,
                       row_number() OVER (PARTITION BY leaf_id ORDER BY "{axes[i % 4]}", id) AS rn FROM l{i}) x)""")
    return _orders_boxes("".join(steps) + f", leaves AS (SELECT * FROM l{levels})") + select


ANCHORS = """anchors AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
    a AS (SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS v FROM anchors JOIN embeddings e USING (vec_id)),
    v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    d AS (SELECT v.vec_id, a.vec_id AS pivot_id, a.label, list_distance(v.v, a.v) AS dist FROM v, a)"""


def _farthest_first(n: int) -> str:
    """``n`` rounds written out: each takes the row that is farthest from its nearest anchor."""
    rounds = """v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    p0 AS MATERIALIZED (SELECT * FROM v ORDER BY vec_id LIMIT 1),
    d0 AS MATERIALIZED (SELECT v.vec_id, v.v, list_distance(v.v, p0.v) AS d FROM v, p0)"""
    for i in range(1, n):
        rounds += f""",
    p{i} AS MATERIALIZED (SELECT vec_id, v FROM d{i - 1} WHERE d > 0 ORDER BY d DESC, vec_id LIMIT 1),
    d{i} AS MATERIALIZED (SELECT e.vec_id, e.v, least(e.d, list_distance(e.v, p{i}.v)) AS d FROM d{i - 1} e, p{i})"""
    return f"WITH {rounds} " + " UNION ALL ".join(f"SELECT vec_id FROM p{i}" for i in range(n))


VECTOR_PAIRS = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT a.vec_id, b.vec_id AS nb_vec_id, round(list_distance(a.v, b.v), 6) AS distance
    FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= {q.VECTOR_RADIUS}"""


def _parts(unit: str, quantity: int, key: str = "", name: str = "value", bounds: bool = True) -> str:
    whole = {"second": "CAST(floor(date_part('microseconds', ts) / 1e6) AS INT)"}
    part = lambda u: whole.get(u, f"CAST(date_part('{u}', ts) AS INT)")
    order = ["year", "month", "day", "hour", "minute", "second"]
    chosen = order[: order.index(unit) + 1]
    columns = [f"{part(u)}{f' // {quantity}' if u == unit else ''} AS {u}" for u in chosen]
    keys = ([key] if key else []) + columns
    where = "WHERE value > 1 AND value < 300" if bounds else ""
    return f"SELECT {', '.join(keys)}, round(avg(value), 6) AS {name} FROM events {where} GROUP BY ALL"


def _line_counts(cap: int | None = None) -> str:
    r = q.LINE_RADIUS
    dist = _dist("l_quantity", "l_discount", "l_tax", nominal=("l_returnflag",))
    count = "sum(b.n) - 1" if cap is None else f"least(sum(b.n) - 1, {cap})"
    return f"""WITH g AS (
      SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    c AS (
      SELECT a.l_quantity, a.l_discount, a.l_tax, a.l_returnflag, CAST({count} AS BIGINT) AS neighbors
      FROM g a JOIN g b ON b.l_quantity BETWEEN a.l_quantity - {r} AND a.l_quantity + {r} AND {dist} <= {r}
      GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, neighbors
    FROM lineitem JOIN c USING (l_quantity, l_discount, l_tax, l_returnflag)"""


def _walk() -> str:
    m, k = q.SPEC.panes, q.PARAMS.k
    return f""", ev AS (SELECT seq, nb_sl, count(*) AS n FROM nb GROUP BY ALL),
    walk AS (
      SELECT window_id, st.seq, nb_sl AS nb_slide, ev.n, status,
             CAST(succ + sum(ev.n) OVER (PARTITION BY window_id, st.seq ORDER BY nb_sl DESC) AS BIGINT) AS found
      FROM st JOIN ev ON ev.seq = st.seq AND nb_sl < sl AND nb_sl > window_id - {m} WHERE status <> 'Safe'),
    least_walk AS (SELECT * FROM walk WHERE found - n < {k})"""


TRIGGERS = """, trig AS (
    SELECT window_id, seq, min(nb_slide) AS trigger_slide FROM least_walk WHERE status = 'Unsafe' GROUP BY ALL)"""


def _arrivals() -> str:
    return f"WITH {_points(1)}, {_neighbors(1, q.ARRIVAL_WIDTH, q.PARAMS.radius)}"


def _schedule() -> str:
    """Checks one after the other, by lists of earlier (newest first) and later neighbours."""
    k, width = q.PARAMS.k, q.ARRIVAL_WIDTH
    succ = "len(list_filter(f, lambda x: x <= chk))"
    due = f"e[{k} - {succ}]"
    return f"""{_arrivals().replace('WITH', 'WITH RECURSIVE', 1)}, l AS (
        SELECT p.seq, p.n, coalesce(list(nb_seq ORDER BY nb_seq DESC) FILTER (nb_seq < p.seq), []) AS e,
            coalesce(list(nb_seq ORDER BY nb_seq) FILTER (nb_seq > p.seq), []) AS f
        FROM p LEFT JOIN nb ON nb.seq = p.seq GROUP BY p.seq, p.n
    ), c AS (
        SELECT seq, seq AS chk FROM l
        UNION ALL
        SELECT c.seq, {due} + {width} FROM c JOIN l USING (seq) WHERE {succ} < {k} AND {due} > chk - {width} AND {due} + {width} <= n
    )
    SELECT seq, chk AS check_seq, CASE WHEN {succ} >= {k} THEN 'Safe' WHEN {due} > chk - {width} THEN 'Unsafe' ELSE 'Outlier' END AS status
    FROM c JOIN l USING (seq)"""


def _timeline(w: int = q.ARRIVAL_WIDTH, params=q.PARAMS, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""WITH {_points(1, key)}, {_neighbors(1, w, params.radius, key)},
    e AS (
      SELECT {k}n, seq, seq AS at_seq, 0 AS ds, 0 AS dp FROM p
      UNION ALL SELECT {k}NULL, seq, nb_seq, 1, 0 FROM nb WHERE nb_seq > seq
      UNION ALL SELECT {k}NULL, seq, seq, 0, 1 FROM nb WHERE nb_seq < seq
      UNION ALL SELECT {k}NULL, seq, nb_seq + {w}, 0, -1 FROM nb WHERE nb_seq < seq),
    f AS (SELECT *, max(n) OVER ({f'PARTITION BY {key}' if key else ''}) AS last FROM e),
    g AS (SELECT {k}seq, at_seq, sum(ds) AS ds, sum(dp) AS dp FROM f WHERE at_seq <= last GROUP BY ALL),
    c AS (SELECT {k}seq, at_seq, CAST(sum(ds) OVER o AS BIGINT) AS succ, CAST(sum(dp) OVER o AS BIGINT) AS prev
          FROM g WINDOW o AS (PARTITION BY {k}seq ORDER BY at_seq)),
    s AS (SELECT *, {STATUS.format(k=params.k)} AS status FROM c),
    l AS (SELECT *, lag(status) OVER (PARTITION BY {k}seq ORDER BY at_seq) AS was FROM s)
    SELECT {k}seq, at_seq, succ, prev, status FROM l WHERE was IS NULL OR was <> status"""


def _sweep() -> str:
    slide, widths = q.SWEEP["slide"], q.SWEEP["widths"]
    panes = max(widths) // slide
    values = lambda xs: ", ".join(f"({x})" for x in xs)
    return f"""WITH {_points(slide)}, {_neighbors(slide, panes, max(q.SWEEP['radii']))},
    ws AS (SELECT * FROM (VALUES {values(widths)}) x(width)),
    rs AS (SELECT radius::DOUBLE AS radius FROM (VALUES {values(q.SWEEP['radii'])}) x(radius)),
    ks AS (SELECT * FROM (VALUES {values(q.SWEEP['ks'])}) x(k)),
    w AS (SELECT p.*, width, width // {slide} AS m, sl + j AS window_id FROM p, ws, range({panes}) r(j)
          WHERE j < width // {slide} AND sl + j >= width // {slide} - 1 AND sl + j < n // {slide}),
    c AS (SELECT width, radius, window_id, w.seq,
                 count(nb_sl) FILTER (WHERE nb_sl >= w.sl) AS succ, count(nb_sl) FILTER (WHERE nb_sl < w.sl) AS prev
          FROM w CROSS JOIN rs LEFT JOIN nb ON nb.seq = w.seq AND nb_sl BETWEEN window_id - m + 1 AND window_id AND dist <= radius
          GROUP BY ALL),
    st AS (SELECT *, {STATUS.format(k='k')} AS status FROM c, ks)
    SELECT width, radius, k, window_id, count(*) AS points, count(*) FILTER (WHERE status = 'Safe') AS safe,
           count(*) FILTER (WHERE status = 'Unsafe') AS unsafe, count(*) FILTER (WHERE status = 'Outlier') AS outliers
    FROM st GROUP BY ALL"""


def _clusters() -> str:
    side = q.PARAMS.radius * (1.0 - 1e-9)
    return f"""WITH {_points(q.SPEC.slide)},
    cl AS (
      SELECT sl AS slide_id, event_type, min(seq) AS cluster_id, arg_min(value, seq) AS value, count(*) AS n,
             greatest(max(value) - arg_min(value, seq), arg_min(value, seq) - min(value)) AS radius
      FROM p GROUP BY sl, event_type, floor(value / {side!r}))"""


def _sensor_chain() -> str:
    spec, params = t.USER_SPEC, t.USER_PARAMS
    s, m = spec.slide, spec.panes
    means = _parts("hour", 6, "user_id").replace("round(avg(value), 6)", "avg(value)")
    dist = _dist("value")
    return f"""WITH means AS ({means}),
    diffs AS (SELECT user_id, year, month, day, hour, value - lag(value) OVER o AS value, row_number() OVER o AS rn
              FROM means WINDOW o AS (PARTITION BY user_id ORDER BY year, month, day, hour)),
    p AS (SELECT *, (seq - 1) // {s} AS sl FROM (
            SELECT user_id, day, hour, value, row_number() OVER (PARTITION BY user_id ORDER BY year, month, day, hour) AS seq,
                   count(*) OVER (PARTITION BY user_id) AS n FROM diffs WHERE rn > 1) x),
    w AS (SELECT p.*, sl + j AS window_id FROM p, range({m}) r(j) WHERE sl + j >= {m - 1} AND sl + j < n // {s}),
    c AS (SELECT a.user_id, window_id, a.seq, a.day, a.hour,
                 count(b.seq) FILTER (WHERE b.sl >= a.sl) AS succ, count(b.seq) FILTER (WHERE b.sl < a.sl) AS prev
          FROM w a LEFT JOIN p b ON a.user_id = b.user_id AND a.seq <> b.seq
           AND b.sl BETWEEN window_id - {m - 1} AND window_id AND {dist} <= {params.radius} GROUP BY ALL)
    SELECT *, {STATUS.format(k=params.k)} AS status FROM c"""


def oracle_sql() -> dict[str, str]:
    m, s = q.SPEC.panes, q.SPEC.slide
    wide = type(q.SPEC)(1000, 500)
    status = "SELECT window_id, seq, event_id, succ, prev, status FROM st"
    keyed_status = "SELECT user_id, window_id, seq, event_id, succ, prev, status FROM st"
    report = f"""SELECT window_id, (window_id - {m - 1}) * {s} + 1 AS from_seq, (window_id + 1) * {s} AS to_seq, seq, event_id{{user}},
                 succ, prev, status, succ + prev AS n_neighbors FROM st"""
    keyed = _window_sql(keyed_status, t.USER_SPEC, t.USER_PARAMS, "user_id")
    outliers = "SELECT window_id, seq, event_id, status FROM st WHERE status = 'Outlier'"
    order_dist = _dist("o_totalprice", "o_day", nominal=("o_orderstatus",))
    hits = f"h AS ({BOX_PAIRS}), g AS (SELECT id, string_agg(hit, ',' ORDER BY hit) AS hits FROM h GROUP BY id)"
    cells_far = "{}".format(q.PARAMS.radius)
    sql = {
        "number_rows": f"WITH {_points(1)} SELECT event_id, seq, n AS stream_rows FROM p",
        "number_rows_keyed": f"WITH {_points(1, 'user_id')} SELECT user_id, event_id, seq, n AS stream_rows FROM p",
        "sliding_windows": _window_sql("SELECT window_id, sl AS slide_id, seq, event_id FROM w"),
        "window_bounds": _window_sql("SELECT window_id, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS points FROM w GROUP BY 1"),
        "slide_sizes": f"WITH {_points(s)} SELECT sl AS slide_id, count(*) AS points FROM p GROUP BY 1",
        "window_status": _window_sql(status),
        "window_status_wide": _window_sql(status, wide),
        "window_status_ordered": _window_sql(status, wide),
        "window_status_keyed": keyed,
        "window_report": _window_sql(report.format(user=", user_id")),
        "window_outliers": _window_sql(report.format(user="") + " WHERE status = 'Outlier'"),
        "outlier_counts": _window_sql("""SELECT window_id, count(*) AS points, count(*) FILTER (WHERE status = 'Safe') AS safe,
            count(*) FILTER (WHERE status = 'Unsafe') AS unsafe, count(*) FILTER (WHERE status = 'Outlier') AS outliers FROM st GROUP BY 1"""),
        "window_pairs": f"WITH {_points(s)}, {_neighbors(s, m, q.PARAMS.radius)} SELECT seq, sl AS slide_id, nb_seq, nb_sl AS nb_slide, round(dist, 6) AS distance FROM nb",
        "window_evidence": f"WITH {_points(s)}, {_neighbors(s, m, q.PARAMS.radius)} SELECT seq, sl AS slide_id, nb_sl AS nb_slide, count(*) AS n FROM nb GROUP BY ALL",
        "evidence_map": f"WITH {_points(s)}, {_neighbors(s, m, q.PARAMS.radius)} SELECT seq, count(*) AS prev_total FROM nb WHERE nb_sl < sl GROUP BY 1",
        "minimal_evidence": _window_sql("SELECT window_id, seq, nb_slide, n, found, status FROM least_walk", more=_walk()),
        "trigger_slide": _window_sql("SELECT * FROM trig", more=_walk() + TRIGGERS),
        "due_checks": _window_sql(f"""SELECT DISTINCT trigger_slide AS slide_id, seq FROM trig
            WHERE trigger_slide <= (SELECT max(window_id) - {m} FROM w)""", more=_walk() + TRIGGERS),
        "preceding_neighbors": f"""{_arrivals()} SELECT p.seq, coalesce(string_agg(nb_seq, ',' ORDER BY nb_seq), '') AS pre_neighbors
            FROM p LEFT JOIN nb ON nb.seq = p.seq AND nb_seq < p.seq GROUP BY p.seq""",
        "next_check": f"""{_arrivals()}, r AS (SELECT seq, nb_seq, row_number() OVER (PARTITION BY seq ORDER BY nb_seq DESC) AS rn,
            count(*) OVER (PARTITION BY seq) AS n_prev FROM nb WHERE nb_seq < seq)
            SELECT seq, n_prev, nb_seq + {q.ARRIVAL_WIDTH} AS check_seq FROM r WHERE rn = {q.PARAMS.k}""",
        "check_schedule": _schedule(),
        "status_timeline": _timeline(),
        "stream_status_changes": _timeline(q.t.USER_SPEC.width, q.t.USER_PARAMS, "user_id"),
        "cell_outliers": _window_sql(outliers),
        "cell_outliers_wide": _window_sql(outliers, wide),
        "micro_clusters": _clusters() + " SELECT slide_id, cluster_id, event_type, value, n, round(radius, 6) AS radius FROM cl",
        "cluster_neighbors": _clusters() + f""" SELECT a.slide_id, a.cluster_id, b.slide_id AS nb_slide, b.cluster_id AS nb_cluster,
            round({EVENT_DIST}, 6) AS distance FROM cl a JOIN cl b ON abs(a.slide_id - b.slide_id) < {m} AND a.cluster_id <> b.cluster_id
            AND {EVENT_DIST} <= {cells_far} + a.radius + b.radius""",
        "parameter_sweep": _sweep(),
        "live_points": f"WITH {_points(1)} SELECT seq, event_id, seq + {q.ARRIVAL_WIDTH} AS exp_seq FROM p WHERE seq > n - {q.ARRIVAL_WIDTH}",
        "remove_points": "SELECT event_id, value FROM events WHERE event_type <> 'error'",
        "mixed_distances": f"""WITH {_points(1)} SELECT a.seq, round({EVENT_DIST}, 6) AS distance,
            round((a.value-b.value)*(a.value-b.value) + CASE WHEN a.event_type=b.event_type THEN 0.0 ELSE 1.0 END, 6) AS squared,
            CASE WHEN {EVENT_DIST} <= {q.PARAMS.radius} THEN 1 ELSE 0 END AS near FROM p a JOIN p b ON b.seq + 1 = a.seq""",
        "range_join_mixed": f"""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus,
            datediff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS o_day FROM orders)
            SELECT a.o_orderkey, b.o_orderkey AS nb_o_orderkey, round({order_dist}, 6) AS distance FROM o a JOIN o b
            ON b.o_totalprice BETWEEN a.o_totalprice - {q.ORDERS_RADIUS + 0.001} AND a.o_totalprice + {q.ORDERS_RADIUS + 0.001}
            AND a.o_orderkey <> b.o_orderkey AND {order_dist} <= {q.ORDERS_RADIUS}""",
        "range_join_self": f"""SELECT a.event_id, b.event_id AS nb_event_id, round({EVENT_DIST}, 6) AS distance FROM events a JOIN events b
            ON a.event_type = b.event_type AND {EVENT_DIST} <= {q.SELF_RADIUS}""",
        "range_join_vec": VECTOR_PAIRS,
        "pivot_range_join": VECTOR_PAIRS,
        "anchor_tree_join": VECTOR_PAIRS,
        "farthest_first_pivots": _farthest_first(8),
        "neighbor_counts": _line_counts(),
        "neighbor_counts_capped": _line_counts(6),
        "neighbor_counts_ordered": f"""WITH n AS (SELECT a.event_id, count(*) AS neighbors FROM events a JOIN events b
            ON a.event_id <> b.event_id AND b.value BETWEEN a.value - {q.PARAMS.radius} AND a.value + {q.PARAMS.radius}
            AND {EVENT_DIST} <= {q.PARAMS.radius} GROUP BY 1)
            SELECT event_id, coalesce(neighbors, 0) AS neighbors FROM events LEFT JOIN n USING (event_id)""",
        "assign_pivots": f"WITH {ANCHORS} SELECT vec_id, arg_min(pivot_id, dist) AS pivot_id, round(min(dist), 6) AS distance FROM d GROUP BY 1",
        "assign_covering_pivots": f"""WITH {ANCHORS}, r AS (SELECT *, 1.2::DOUBLE + label * 0.01::DOUBLE AS radius FROM d),
            k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY (dist > radius)::INT,
                  CASE WHEN dist <= radius THEN dist ELSE dist - radius END, pivot_id) AS rn FROM r)
            SELECT vec_id, pivot_id, round(dist, 6) AS distance FROM k WHERE rn = 1""",
        "pivot_radius": f"""WITH {ANCHORS}, h AS (SELECT vec_id, arg_min(pivot_id, dist) AS pivot_id, min(dist) AS dist FROM d GROUP BY 1)
            SELECT pivot_id, round(max(dist), 6) AS radius, count(*) AS members FROM h GROUP BY 1""",
        "split_between_anchors": f"""WITH {ANCHORS}, o AS (SELECT vec_id, dist, rank() OVER (ORDER BY label) AS r FROM d),
            s AS (SELECT vec_id, min(dist) FILTER (WHERE r = (SELECT min(r) FROM o)) AS d1,
                  min(dist) FILTER (WHERE r = (SELECT min(r) FROM o WHERE r > 1)) AS d2 FROM o GROUP BY 1)
            SELECT vec_id, CASE WHEN d1 >= d2 THEN 2 ELSE 1 END AS side, round(least(d1, d2), 6) AS distance FROM s""",
        "bucket_means_second": _parts("second", 30),
        "bucket_means_minute": _parts("minute", 10),
        "bucket_means_hour": _parts("hour", 6),
        "bucket_means_day": _parts("day", 1),
        "hourly_means": _parts("hour", 1, "user_id", "avg_value", bounds=False),
        "csv_round_trip": _parts("hour", 1, "user_id", bounds=False),
        "sorted_parquet_round_trip": _parts("hour", 1, bounds=False),
        "plausible_rows": "SELECT event_id, value FROM events WHERE value > 1 AND value < 300",
        "first_difference": """WITH d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
            SELECT user_id, event_id, round(d, 4) AS value, round(abs(d), 4) AS magnitude FROM d WHERE d IS NOT NULL""",
        "sensor_chain": _sensor_chain(),
        "delimited_cells": "SELECT event_id, event_type, 3 AS n FROM events",
        "parsed_points": "SELECT event_id::DOUBLE AS event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events",
        "split_at": """SELECT CASE WHEN rn < 5000 THEN 'left' WHEN rn = 5000 THEN 'kth' ELSE 'right' END AS part, o_orderkey, o_totalprice
            FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) x""",
        "first_row": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1",
        "last_row": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1",
        "drop_first": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) x WHERE rn > 1",
        "partition_rows": "SELECT count(*) AS rows FROM lineitem",
        "box_pairs": _orders_boxes() + BOX_PAIRS,
        "box_join_regions": _orders_boxes() + BOX_PAIRS,
        "box_hits": _orders_boxes(f", {hits}") + "SELECT id, hits FROM g",
        "box_hits_with_empty": _orders_boxes(f", {hits}") + "SELECT b.id, coalesce(hits, '') AS hits FROM b LEFT JOIN g USING (id)",
        "total_hits": _orders_boxes() + f"SELECT count(*) AS total_hits FROM ({BOX_PAIRS}) x",
        "tiled_total_hits": _orders_boxes() + f"SELECT 9 * count(*) AS total_hits FROM ({BOX_PAIRS}) x",
        "extent": _orders_boxes() + """SELECT min("xMin") AS "xMin", min("yMin") AS "yMin", max("xMax") AS "xMax", max("yMax") AS "yMax",
            count(*) AS boxes, max("xMax") - min("xMin") + 1 AS "xExtent", max("yMax") - min("yMin") + 1 AS "yExtent" FROM b""",
        "tile_boxes": _orders_boxes(""", x AS (SELECT max("xMax") - min("xMin") + 1 AS w, max("yMax") - min("yMin") + 1 AS h, count(*) AS n FROM b)""")
        + """SELECT id + (i * 3 + j) * n AS id, "xMin" + j * w AS "xMin", "yMin" + i * h AS "yMin", "xMax" + j * w AS "xMax", "yMax" + i * h AS "yMax"
            FROM b, x, range(3) r(i), range(3) s(j)""",
        "kd_partition": _kd("SELECT id, leaf_id FROM leaves"),
        "leaf_regions": _kd("""SELECT leaf_id, min("xMin") AS "xMin", min("yMin") AS "yMin", max("xMax") AS "xMax", max("yMax") AS "yMax",
            count(*) AS boxes FROM leaves GROUP BY 1"""),
        "rejected_boxes": _orders_boxes(""", turned AS (SELECT id, "xMin", "yMin", "xMax", "yMax" - id % 5 - 1 AS "yMax" FROM b)""")
        + """SELECT * FROM turned WHERE NOT ("xMin" < "xMax" AND "yMin" < "yMax")""",
        "box_order": _orders_boxes() + f"""SELECT a.id, (a."xMin", a.id) < (b."xMin", b.id) AS x_less, (a."yMax", a.id) > (b."yMax", b.id) AS y_more,
            a.id <> b.id AND {BOX_MEET} AS meets FROM b a, (SELECT * FROM b ORDER BY "yMax", id LIMIT 1) b""",
        "stream_window_status": _window_sql(status),
        "stream_window_status_keyed": keyed,
        "stream_outliers_by_key": keyed,
    }
    sql["boxes_from_file"] = sql["extent"]
    keys = ", ".join(f'(a."{c}", a.id) {sign} (b."{c}", b.id) AS "{c}_{word}"'
                     for sign, word in (("<", "less"), (">", "more")) for c in ("xMin", "yMin", "xMax", "yMax"))
    sql["super_keys"] = _orders_boxes() + f"""SELECT a.id, {keys} FROM b a, (SELECT * FROM b ORDER BY "yMax", id LIMIT 1) b"""
    lines = _orders_boxes().replace("WITH b AS", "WITH o AS") + """, b AS (
        SELECT row_number() OVER (ORDER BY id) - 1 AS id, "xMin", "yMin", "xMax", "yMax" FROM o)"""
    sql["box_file_ids"] = lines + " SELECT * FROM b"
    sql["box_job"] = lines + f", {hits} SELECT id, hits FROM g"
    sql["vector_distances"] = """SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance
        FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1"""
    return sql
