"""Sliding windows, labels, scaling, index, alignment and data splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gauge_engine.catalog.registry import emit, explode_block, query, table
from gauge_engine.catalog.stand_ins import (
    EVENT_READINGS,
    EVENTS,
    ORDER_READINGS,
    ORDERS,
    PENDING_READINGS,
    block_rows,
    event_readings,
    order_readings,
    pending_orders_unread,
    series_ctes,
    window_ctes,
)
from gauge_engine.functions.arrays import flatten_block, reshape_block
from gauge_engine.functions.scalars import class_weight, sigmoid
from gauge_engine.operators.align import align_to_index, complete_predictions, constant_predictions
from gauge_engine.operators.daily import add_features, daily_slim
from gauge_engine.operators.index import calendar_index, index_with_ids
from gauge_engine.operators.metrics import class_balance, label_balance
from gauge_engine.operators.ordering import with_positional_id
from gauge_engine.operators.scaling import apply_scaler, fit_scaler
from gauge_engine.operators.splits import split_random, split_stratified, split_tail
from gauge_engine.operators.windows import window_anchors
from gauge_engine.operators.thresholds import thresholds
from gauge_engine.plans.training import (
    flagged_daily,
    scoring_windows,
    scoring_windows_segmented,
    training_windows,
    training_windows_segmented,
    windows_of,
)
from gauge_engine.sources.sinks import store_bucketed

KEY_SQL = "k AS o_orderpriority, CAST(hist_start AS VARCHAR) AS hist_start, CAST(future_start AS VARCHAR) AS future_start"
KEYS = ["o_orderpriority", "hist_start", "future_start"]
FOUR = ("v", "m3", "m7", "s7")


def _anchors(name: str, drop_last: bool) -> None:
    reach = 21 if drop_last else 20
    sql = series_ctes(ORDER_READINGS) + f"""
SELECT a.k AS o_orderpriority, CAST(a.d AS VARCHAR) AS hist_start, CAST(h.d AS VARCHAR) AS future_start
FROM f a JOIN f h ON a.k = h.k AND h.rn = a.rn + 7 WHERE a.rn + {reach} <= a.n"""

    @query(name, sql)
    def _(spark, sf):
        return emit(window_anchors(daily_slim(order_readings(spark, sf), ORDERS), ORDERS, drop_last=drop_last))


_anchors("window_anchors", False)
_anchors("window_anchors_droplast", True)


@query(
    "hist_vector",
    window_ctes(ORDER_READINGS) + block_rows() + f"SELECT {KEY_SQL}, pos, round(x, 4) AS x FROM b",
)
def _(spark, sf):
    windows = scoring_windows(order_readings(spark, sf), ORDERS)
    return emit(explode_block(windows.select(*KEYS, "x")))


@query(
    "hist_matrix",
    window_ctes(ORDER_READINGS, FOUR)
    + block_rows(FOUR)
    + f"SELECT {KEY_SQL}, CAST(pos // 4 AS INTEGER) AS step, CAST(pos % 4 AS INTEGER) AS pos, round(x, 4) AS x FROM b",
)
def _(spark, sf):
    windows = scoring_windows(order_readings(spark, sf), ORDERS, ORDERS.sequence_features, layout="matrix")
    steps = windows.select(*KEYS, F.posexplode("x").alias("step", "x"))
    return emit(explode_block(steps))


@query(
    "reshape_block",
    window_ctes(EVENT_READINGS, FOUR)
    + block_rows(FOUR)
    + """SELECT k AS event_type, CAST(hist_start AS VARCHAR) AS hist_start,
           CAST(pos // 4 AS INTEGER) AS step, pos, round(x, 4) AS x FROM b""",
)
def _(spark, sf):
    windows = scoring_windows(event_readings(spark, sf), EVENTS, EVENTS.sequence_features)
    matrix = windows.select("event_type", "hist_start", reshape_block("x", 4).alias("m"))
    numbered = F.transform(
        "m", lambda row, i: F.transform(row, lambda v, j: F.struct(i.alias("step"), (i * 4 + j).alias("pos"), v.alias("x")))
    )
    cells = matrix.select("event_type", "hist_start", F.explode(flatten_block(numbered)).alias("c"))
    return emit(cells.select("event_type", "hist_start", "c.step", "c.pos", "c.x"))


@query(
    "horizon_labels",
    window_ctes(ORDER_READINGS) + f"SELECT {KEY_SQL}, y_days FROM w",
)
def _(spark, sf):
    return emit(training_windows(order_readings(spark, sf), ORDERS).select(*KEYS, "y_days"))


@query("any_label", window_ctes(ORDER_READINGS) + f"SELECT {KEY_SQL}, y FROM w")
def _(spark, sf):
    return emit(training_windows(order_readings(spark, sf), ORDERS).select(*KEYS, "y"))


@query("window_null_guard", window_ctes(PENDING_READINGS) + f"SELECT {KEY_SQL} FROM w")
def _(spark, sf):
    return emit(scoring_windows(pending_orders_unread(spark, sf), ORDERS).select(*KEYS))


@query(
    "training_windows",
    window_ctes(PENDING_READINGS, FOUR)
    + block_rows(FOUR)
    + """SELECT b.k AS o_orderpriority, CAST(b.hist_start AS VARCHAR) AS hist_start,
           CAST(b.future_start AS VARCHAR) AS future_start, y, y_days, pos, round(x, 4) AS x
         FROM b JOIN w ON b.k = w.k AND b.rn = w.rn""",
)
def _(spark, sf):
    windows = training_windows(pending_orders_unread(spark, sf), ORDERS, ORDERS.sequence_features)
    return emit(explode_block(windows))


@query(
    "windows_bucketed",
    window_ctes(ORDER_READINGS) + f"SELECT {KEY_SQL}, y, y_days FROM w",
)
def _(spark, sf):
    """Windows over a flagged series that is stored in sorted buckets of its entities."""
    flagged = flagged_daily(order_readings(spark, sf), ORDERS)
    stored = store_bucketed(flagged, f"flagged_days_{uuid.uuid4().hex}", ORDERS.entity, ORDERS.date)
    return emit(windows_of(stored, ORDERS).drop("x"))


@query(
    "windows_segmented_given",
    window_ctes(ORDER_READINGS, basis="daily", drop_last=True, guard=False) + f"SELECT {KEY_SQL}, y, y_days FROM w",
)
def _(spark, sf):
    """Segmented windows with given thresholds and without the last anchor of each entity."""
    readings = order_readings(spark, sf)
    table = thresholds(daily_slim(readings, ORDERS), ORDERS)
    windows = training_windows_segmented(
        readings, ORDERS, segment_rows=64, table=table, drop_last=True, guard_nulls=False
    )
    return emit(windows.drop("x"))


@query(
    "scoring_windows_segmented",
    window_ctes(ORDER_READINGS) + block_rows() + f"SELECT {KEY_SQL}, pos, round(x, 4) AS x FROM b",
)
def _(spark, sf):
    return emit(explode_block(scoring_windows_segmented(order_readings(spark, sf), ORDERS, segment_rows=64)))


@query(
    "training_windows_daily_basis",
    window_ctes(ORDER_READINGS, basis="daily", drop_last=True, guard=False) + f"SELECT {KEY_SQL}, y, y_days FROM w",
)
def _(spark, sf):
    windows = training_windows(
        order_readings(spark, sf), ORDERS, basis="daily", drop_last=True, guard_nulls=False
    )
    return emit(windows.drop("x"))


@query(
    "training_windows_segmented",
    window_ctes(PENDING_READINGS, FOUR)
    + block_rows(FOUR)
    + """SELECT b.k AS o_orderpriority, CAST(b.hist_start AS VARCHAR) AS hist_start,
           CAST(b.future_start AS VARCHAR) AS future_start, y, y_days, pos, round(x, 4) AS x
         FROM b JOIN w ON b.k = w.k AND b.rn = w.rn""",
)
def _(spark, sf):
    windows = training_windows_segmented(
        pending_orders_unread(spark, sf), ORDERS, ORDERS.sequence_features, segment_rows=200
    )
    return emit(explode_block(windows))


# --- balance and weights ----------------------------------------------------------------------

_BALANCE = """SELECT CAST(count(*) FILTER (WHERE {y} = 1) AS BIGINT) AS pos,
  CAST(count(*) FILTER (WHERE {y} = 0) AS BIGINT) AS neg, round(avg({y}), 6) AS rate,
  round(count(*) FILTER (WHERE {y} = 0) / greatest(count(*) FILTER (WHERE {y} = 1), 1)::DOUBLE, 6) AS weight FROM """


@query("class_balance", window_ctes(ORDER_READINGS, guard=False) + _BALANCE.format(y="y") + "w")
def _(spark, sf):
    return emit(class_balance(training_windows(order_readings(spark, sf), ORDERS)), 6)


@query(
    "label_balance",
    window_ctes(ORDER_READINGS, guard=False)
    + _BALANCE.format(y="h.flag")
    + "w JOIN f h ON h.k = w.k AND h.rn BETWEEN w.rn + 7 AND w.rn + 20",
)
def _(spark, sf):
    return emit(label_balance(training_windows(order_readings(spark, sf), ORDERS)), 6)


@query(
    "class_weights",
    window_ctes(ORDER_READINGS, guard=False)
    + f""", balance AS (SELECT count(*) FILTER (WHERE y = 0) / greatest(count(*) FILTER (WHERE y = 1), 1)::DOUBLE AS p FROM w)
SELECT {KEY_SQL}, y, round(CASE WHEN y = 1 THEN p ELSE 1.0 END, 6) AS weight FROM w CROSS JOIN balance""",
)
def _(spark, sf):
    windows = training_windows(order_readings(spark, sf), ORDERS)
    positive = class_balance(windows).select("weight").scalar()
    return emit(windows.select(*KEYS, "y", class_weight("y", positive).alias("weight")), 6)


# --- scaling ------------------------------------------------------------------------------------


@query(
    "scaler_fit",
    window_ctes(PENDING_READINGS, FOUR)
    + block_rows(FOUR)
    + """SELECT CAST(pos % 4 AS INTEGER) AS pos, round(avg(x), 4) AS mean,
           round(CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END, 4) AS std FROM b GROUP BY 1""",
)
def _(spark, sf):
    daily = add_features(daily_slim(pending_orders_unread(spark, sf), ORDERS), ORDERS)
    stats = fit_scaler(daily, ORDERS).select(F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "s"))
    return emit(stats.select("pos", "s.mean", "s.std"))


@query(
    "scaler_apply",
    window_ctes(ORDER_READINGS, FOUR)
    + block_rows(FOUR)
    + f""", s AS (SELECT pos % 4 AS j, avg(x) AS m, stddev_pop(x) AS sd FROM b GROUP BY 1)
SELECT {KEY_SQL}, CAST(pos // 4 AS INTEGER) AS step, CAST(pos % 4 AS INTEGER) AS pos, round((x - m) / sd, 6) AS x
FROM b JOIN s ON b.pos % 4 = s.j""",
)
def _(spark, sf):
    readings = order_readings(spark, sf)
    scaler = fit_scaler(add_features(daily_slim(readings, ORDERS), ORDERS), ORDERS)
    windows = scoring_windows(readings, ORDERS, ORDERS.sequence_features, layout="matrix")
    scaled = apply_scaler(windows, scaler)
    return emit(explode_block(scaled.select(*KEYS, F.posexplode("x").alias("step", "x"))), 6)


# --- index and alignment ------------------------------------------------------------------------

INDEX_CTE = """, idx AS (
  SELECT row_number() OVER (ORDER BY k, d) - 1 AS id, k, d - 7 AS hist_start, d - 1 AS hist_end,
    d AS future_start, d + 13 AS future_end
  FROM (SELECT k, d, min(d) OVER (PARTITION BY k) AS first, max(d) OVER (PARTITION BY k) AS last FROM daily)
  WHERE first <= d - 7 AND last >= d + 13)
"""
_INDEX_COLUMNS = """k AS o_orderpriority, CAST(hist_start AS VARCHAR) AS hist_start,
  CAST(hist_end AS VARCHAR) AS hist_end, CAST(future_start AS VARCHAR) AS future_start,
  CAST(future_end AS VARCHAR) AS future_end"""


@query("index_calendar", series_ctes(ORDER_READINGS) + INDEX_CTE + f"SELECT {_INDEX_COLUMNS} FROM idx")
def _(spark, sf):
    return emit(calendar_index(daily_slim(order_readings(spark, sf), ORDERS), ORDERS))


@query(
    "index_ids",
    series_ctes(ORDER_READINGS) + INDEX_CTE + f"SELECT CAST(id AS BIGINT) AS id, {_INDEX_COLUMNS} FROM idx",
)
def _(spark, sf):
    return emit(index_with_ids(daily_slim(order_readings(spark, sf), ORDERS), ORDERS))


@query(
    "index_align",
    window_ctes(ORDER_READINGS)
    + INDEX_CTE
    + """SELECT CAST(idx.id AS BIGINT) AS id,
           round(coalesce(1 / (1 + exp(-(a.v - 250000) / 100000)), 0.5), 6) AS y_prob
         FROM idx LEFT JOIN w ON idx.k = w.k AND idx.hist_start = w.hist_start AND idx.future_start = w.future_start
         LEFT JOIN f a ON a.k = w.k AND a.rn = w.rn""",
)
def _(spark, sf):
    readings = order_readings(spark, sf)
    score = sigmoid((F.col("x")[0] - 250000) / 100000)
    predictions = scoring_windows(readings, ORDERS).withColumn("y_prob", score)
    return emit(align_to_index(index_with_ids(daily_slim(readings, ORDERS), ORDERS), predictions, ORDERS), 6)


@query(
    "preds_complete",
    """SELECT o_orderkey AS id, round(coalesce(p, 0.5), 6) AS y_prob FROM orders LEFT JOIN
       (SELECT l_orderkey, avg(l_discount) * 10 AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
       ON o_orderkey = l_orderkey""",
)
def _(spark, sf):
    index = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    returned = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    predictions = returned.groupBy(F.col("l_orderkey").alias("id")).agg(
        (F.avg("l_discount") * 10).alias("y_prob")
    )
    return emit(complete_predictions(index, predictions), 6)


@query("default_preds", "SELECT o_orderkey AS id, 0.5::DOUBLE AS y_prob FROM orders")
def _(spark, sf):
    return constant_predictions(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


@query(
    "positional_id",
    """SELECT CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS BIGINT) AS id,
         l_orderkey, l_linenumber FROM lineitem""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return with_positional_id(lines, ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


# --- splits -------------------------------------------------------------------------------------

_HASH = "md5(k || '|' || CAST(hist_start AS VARCHAR) || '|42')"


@query(
    "split_stratified",
    window_ctes(ORDER_READINGS, guard=False)
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH}) AS r,
  count(*) OVER (PARTITION BY y) AS c FROM w)
SELECT k AS o_orderpriority, CAST(hist_start AS VARCHAR) AS hist_start, y,
  CAST(r <= ceil(0.2 * c) AS INTEGER) AS is_validation FROM ranked""",
)
def _(spark, sf):
    windows = training_windows(order_readings(spark, sf), ORDERS).select("o_orderpriority", "hist_start", "y")
    return emit(split_stratified(windows, ["o_orderpriority", "hist_start"]))


@query(
    "split_random",
    window_ctes(ORDER_READINGS, guard=False)
    + f""", ranked AS (SELECT *, row_number() OVER (ORDER BY {_HASH}) AS r, count(*) OVER () AS c FROM w)
SELECT k AS o_orderpriority, CAST(hist_start AS VARCHAR) AS hist_start,
  CAST(r <= floor(0.1 * c) AS INTEGER) AS is_validation FROM ranked""",
)
def _(spark, sf):
    windows = training_windows(order_readings(spark, sf), ORDERS).select("o_orderpriority", "hist_start")
    return emit(split_random(windows, ["o_orderpriority", "hist_start"]))


@query(
    "split_tail",
    window_ctes(ORDER_READINGS, guard=False)
    + """, ranked AS (SELECT *, row_number() OVER (ORDER BY k, hist_start) AS r, count(*) OVER () AS c FROM w)
SELECT k AS o_orderpriority, CAST(hist_start AS VARCHAR) AS hist_start,
  CAST(r > c - floor(0.1 * c) AS INTEGER) AS is_validation FROM ranked""",
)
def _(spark, sf):
    windows = training_windows(order_readings(spark, sf), ORDERS).select("o_orderpriority", "hist_start")
    return emit(split_tail(windows, ["hist_start"], cols=ORDERS))
