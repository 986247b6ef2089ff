"""Horizon functions, seed intervals and training-metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauge_engine.catalog.registry import emit, explode_block, query
from gauge_engine.catalog.stand_ins import (
    EVENTS,
    ORDER_READINGS,
    ORDERS,
    STATUS,
    STATUS_READINGS,
    STATUS_TEST,
    event_readings,
    order_readings,
    series_ctes,
    status_readings,
    week_intervals,
)
from gauge_engine.columns import METRIC_LOG_SCHEMA
from gauge_engine.functions.arrays import horizon_blend, horizon_max
from gauge_engine.functions.scalars import sigmoid
from gauge_engine.operators.daily import add_features, daily_slim
from gauge_engine.operators.intervals import interval_history, interval_truth, readings_in_intervals
from gauge_engine.operators.logs import best_iteration, early_stop
from gauge_engine.operators.windows import sliding_windows
from gauge_engine.plans.evaluate import evaluate_intervals
from gauge_engine.plans.training import flagged_daily
from gauge_engine.session import materialize, scratch_path
from gauge_engine.sources.readers import read_intervals, read_metric_log
from gauge_engine.sources.sinks import write_table


@query(
    "sigmoid",
    """SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice - 250000) / 100000)), 6) AS p FROM orders""",
)
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    p = sigmoid((F.col("o_totalprice") - 250000) / 100000)
    return emit(orders.select("o_orderkey", p.alias("p")), 6)


def _daily_probabilities(spark, sf):
    """Fourteen consecutive daily probabilities per starting day."""
    daily = daily_slim(order_readings(spark, sf), ORDERS)
    vectors = sliding_windows(daily, ORDERS, [ORDERS.value], history=14, horizon=1)
    probs = F.transform("x", lambda v: sigmoid((v - 250000) / 100000))
    return vectors.select("o_orderpriority", "hist_start", probs.alias("probs"))


_PROBS = series_ctes(ORDER_READINGS) + """,
p AS (SELECT a.k, a.d, h.rn - a.rn AS i, 1 / (1 + exp(-(h.v - 250000) / 100000)) AS p
      FROM f a JOIN f h ON h.k = a.k AND h.rn BETWEEN a.rn AND a.rn + 13 WHERE a.rn + 14 <= a.n)
SELECT k AS o_orderpriority, CAST(d AS VARCHAR) AS hist_start, """


@query("horizon_max", _PROBS + "round(max(p), 6) AS y_prob FROM p GROUP BY k, d")
def _(spark, sf):
    probs = _daily_probabilities(spark, sf)
    return emit(probs.select("o_orderpriority", "hist_start", horizon_max("probs").alias("y_prob")), 6)


@query(
    "horizon_blend",
    _PROBS + "round(0.6 * sum(p * (0.5 + i / 13.0)) / sum(0.5 + i / 13.0) + 0.4 * max(p), 6) AS y_prob FROM p GROUP BY k, d",
)
def _(spark, sf):
    probs = _daily_probabilities(spark, sf)
    return emit(probs.select("o_orderpriority", "hist_start", horizon_blend("probs").alias("y_prob")), 6)


# --- seed intervals ------------------------------------------------------------------------------

_WEEKS = """, weeks AS (
  SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM
  (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS s FROM orders)),
hist AS (
  SELECT i, s, k FROM weeks JOIN f ON d BETWEEN s AND s + 6 WHERE k IN ('F', 'O')
  GROUP BY i, s, k HAVING count(*) = 7),
truth AS (
  SELECT g.i, g.k, h.h,
    CASE WHEN count(f.d) OVER (PARTITION BY g.i, g.k) = 14 THEN f.flag ELSE 0 END AS flag
  FROM (SELECT DISTINCT hist.i, hist.s, e.k FROM hist, (SELECT DISTINCT k FROM f WHERE k IN ('F', 'O')) e) g
  CROSS JOIN (SELECT unnest(range(14)) AS h) h
  LEFT JOIN f ON f.k = g.k AND f.d = g.s + 7 + CAST(h.h AS INTEGER))
"""


def _weeks_from_file(spark, sf):
    """The intervals as a tab-separated file with US dates, read back with their numbers."""
    path = scratch_path(spark, "intervals")
    weeks = week_intervals(spark, sf).orderBy("start_date")
    write_table(weeks, path, sep="\t", dateFormat="M/d/yyyy")
    return read_intervals(spark, path)


@query(
    "intervals_scan",
    series_ctes(STATUS_READINGS)
    + _WEEKS
    + "SELECT CAST(i AS INTEGER) AS window_idx, CAST(s AS VARCHAR) AS start_date, CAST(s + 6 AS VARCHAR) AS end_date FROM weeks",
)
def _(spark, sf):
    return emit(_weeks_from_file(spark, sf))


def _status_daily(spark, sf):
    """Flagged and featured days; blocks and truth read them several times."""
    flagged = flagged_daily(status_readings(spark, sf), STATUS, stds=0.5)
    return materialize(add_features(flagged, STATUS, STATUS.tree_features), "status-days")


@query(
    "interval_hist",
    series_ctes(STATUS_READINGS, stds=0.5)
    + _WEEKS
    + """SELECT CAST(i AS INTEGER) AS window_idx, CAST(s AS VARCHAR) AS start_date, CAST(s + 6 AS VARCHAR) AS end_date,
           hist.k AS o_orderstatus, CAST((d - s) * 3 + j AS INTEGER) AS pos,
           round(CASE j WHEN 0 THEN v WHEN 1 THEN m3 ELSE m7 END, 4) AS x
         FROM hist JOIN f ON f.k = hist.k AND d BETWEEN s AND s + 6 CROSS JOIN (SELECT unnest([0, 1, 2]) AS j)""",
)
def _(spark, sf):
    blocks = interval_history(_status_daily(spark, sf), _weeks_from_file(spark, sf), STATUS_TEST, STATUS)
    return emit(explode_block(blocks))


@query(
    "interval_truth",
    series_ctes(STATUS_READINGS, stds=0.5)
    + _WEEKS
    + """SELECT CAST(i AS INTEGER) AS window_idx, k AS o_orderstatus,
           string_agg(CAST(flag AS VARCHAR), ',' ORDER BY h) AS y_days FROM truth GROUP BY i, k""",
)
def _(spark, sf):
    return emit(interval_truth(_status_daily(spark, sf), _weeks_from_file(spark, sf), STATUS_TEST, STATUS))


@query(
    "interval_readings",
    """WITH errors AS (SELECT event_id AS window_idx, ts AS s, ts + INTERVAL 90 MINUTE AS e FROM events WHERE event_type = 'error')
SELECT window_idx, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total
FROM errors JOIN events ON ts >= s AND ts < e GROUP BY 1, 2""",
)
def _(spark, sf):
    """Readings in the 90 minutes from every error on: overlapping intervals of timestamps."""
    readings = event_readings(spark, sf)
    errors = readings.where("event_type = 'error'").select(
        F.col("event_id").alias("window_idx"), F.col("ts").alias("start_time"),
        F.timestamp_add("MINUTE", F.lit(90), "ts").alias("end_time"),
    )
    return emit(
        readings_in_intervals(
            readings.select("event_type", "ts", "value"), errors, "ts", by=["window_idx", "event_type"], sums={"total": "value"}
        )
    )


_SCORES_SQL = """
SELECT CAST(g AS INTEGER) AS window_idx, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
  CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS acc,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn)
    / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc
FROM (SELECT g, count(*) FILTER (WHERE y = 0 AND d = 0) AS tn, count(*) FILTER (WHERE y = 0 AND d = 1) AS fp,
        count(*) FILTER (WHERE y = 1 AND d = 0) AS fn, count(*) FILTER (WHERE y = 1 AND d = 1) AS tp
      FROM decided GROUP BY ROLLUP (g))"""


@query(
    "interval_eval",
    series_ctes(STATUS_READINGS, stds=0.5)
    + _WEEKS
    + """, scored AS (
  SELECT hist.i, hist.k, avg(m7) AS level FROM hist JOIN f ON f.k = hist.k AND d BETWEEN s AND s + 6 GROUP BY 1, 2),
decided AS (
  SELECT truth.i AS g, truth.flag AS y,
    CAST(1 / (1 + exp(-((level - 250000) / 20000 + (h - 6) * 0.1))) > 0.5 AS INTEGER) AS d
  FROM truth JOIN scored ON truth.i = scored.i AND truth.k = scored.k)"""
    + _SCORES_SQL,
)
def _(spark, sf):
    daily, weeks = _status_daily(spark, sf), _weeks_from_file(spark, sf)
    blocks = interval_history(daily, weeks, STATUS_TEST, STATUS, [STATUS.mean_7])
    level = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v) / 7
    probs = F.transform(
        F.sequence(F.lit(0), F.lit(13)),
        lambda h: sigmoid((F.col("level") - 250000) / 20000 + (h - 6) * 0.1),
    )
    scored = blocks.withColumn("level", level).select("window_idx", "o_orderstatus", probs.alias("probs"))
    truth = interval_truth(daily, weeks, STATUS_TEST, STATUS, blocks=blocks)
    return emit(evaluate_intervals(truth, scored, STATUS), 6)


# --- metric logs ---------------------------------------------------------------------------------


def _log_from_file(spark, sf):
    """A tab-separated metric log: the events' daily mean as one run per event type."""
    day = F.datediff("date", F.lit("1970-01-01"))
    log = daily_slim(event_readings(spark, sf), EVENTS).select(
        "event_type", day.alias("iter"), F.col("value").alias("AUC"), F.col("value").alias("Logloss")
    )
    path = scratch_path(spark, "metric-log")
    write_table(log, path, sep="\t")
    return read_metric_log(
        spark, path, T.StructType([T.StructField("event_type", T.StringType()), *METRIC_LOG_SCHEMA.fields])
    )


_LOG = """WITH log AS (SELECT event_type AS k, CAST(ts AS DATE) - DATE '1970-01-01' AS i, avg(value) AS v FROM events GROUP BY 1, 2)"""


@query(
    "log_best",
    _LOG
    + """SELECT k AS event_type, CAST(i AS INTEGER) AS best_iter, round(v, 4) AS best_value FROM
         (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, i) AS r FROM log) WHERE r = 1""",
)
def _(spark, sf):
    return emit(best_iteration(_log_from_file(spark, sf), "event_type"))


@query(
    "log_early_stop",
    _LOG
    + """, a AS (SELECT *, row_number() OVER w AS rn,
           coalesce(v < min(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better
         FROM log WINDOW w AS (PARTITION BY k ORDER BY i)),
       b AS (SELECT *, rn - max(CASE WHEN better THEN rn END) OVER (PARTITION BY k ORDER BY i) AS since FROM a),
       c AS (SELECT *, min(CASE WHEN since >= 5 THEN rn END) OVER (PARTITION BY k) AS stop FROM b)
       SELECT k AS event_type, CAST(max(i) FILTER (WHERE rn = stop) AS INTEGER) AS stop_iter,
         CAST(arg_max(i, rn) FILTER (WHERE better AND (stop IS NULL OR rn <= stop)) AS INTEGER) AS best_iter,
         round(arg_max(v, rn) FILTER (WHERE better AND (stop IS NULL OR rn <= stop)), 4) AS best_value
       FROM c GROUP BY k""",
)
def _(spark, sf):
    return emit(early_stop(_log_from_file(spark, sf), "event_type"))
