"""Daily series, thresholds, flags, rolling features, entity filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gauge_engine.catalog.registry import emit, query, table
from gauge_engine.catalog.stand_ins import (
    EVENT_READINGS,
    EVENTS,
    EVENTS_TEST,
    EVENTS_TRAIN,
    ORDER_READINGS,
    ORDERS,
    PENDING_READINGS,
    event_readings,
    order_readings,
    pending_orders_unread,
    series_ctes,
    whole_seconds,
)
from gauge_engine.columns import SensorColumns
from gauge_engine.functions.scalars import UNIX_EPOCH_DAYNUM, composite_key, daynum_to_timestamp
from gauge_engine.operators.daily import (
    add_features,
    daily_rollup,
    daily_selfjoin,
    daily_slim,
    daily_tumbling,
    preview_per_key,
    row_position,
    sorted_daily,
)
from gauge_engine.operators.maintained import DailyStore
from gauge_engine.operators.metrics import CountedTables
from gauge_engine.operators.splits import keep_entities, keep_listed_entities, split_entities, union_entities
from gauge_engine.operators.thresholds import attach_thresholds, flag_events, reading_thresholds, thresholds
from gauge_engine.plans.training import flagged_daily
from gauge_engine.session import scratch_path


@query(
    "daily_rollup",
    """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
         round(avg(value), 4) AS value, round(max(value), 4) AS value_max,
         arg_min(user_id, ts) AS user_id
       FROM events GROUP BY event_type, CAST(ts AS DATE)""",
)
def _(spark, sf):
    return emit(daily_rollup(event_readings(spark, sf), EVENTS))


@query(
    "daily_rollup_nan",
    f"""SELECT k AS o_orderpriority, CAST(d AS VARCHAR) AS date, round(avg(v), 4) AS o_totalprice,
          round(max(v), 4) AS o_totalprice_max
        FROM ({PENDING_READINGS}) GROUP BY k, d""",
)
def _(spark, sf):
    return emit(daily_rollup(pending_orders_unread(spark, sf), ORDERS))


@query(
    "daily_slim",
    f"""SELECT k AS o_orderpriority, CAST(d AS VARCHAR) AS date, round(avg(v), 4) AS o_totalprice,
          round(max(v), 4) AS o_totalprice_max
        FROM ({ORDER_READINGS}) GROUP BY k, d""",
)
def _(spark, sf):
    return emit(daily_slim(order_readings(spark, sf), ORDERS))


@query(
    "daily_tumbling",
    f"""WITH r AS ({EVENT_READINGS}),
        thr AS (SELECT k, avg(v) + 1.5 * stddev_samp(v) AS t FROM r GROUP BY k)
        SELECT r.k AS event_type, CAST(r.d AS VARCHAR) AS date, round(avg(v), 4) AS value,
          round(max(v), 4) AS value_max, round(any_value(t), 4) AS event_threshold
        FROM r JOIN thr ON r.k = thr.k GROUP BY r.k, r.d""",
)
def _(spark, sf):
    readings = event_readings(spark, sf)
    days = daily_tumbling(readings, EVENTS)
    return emit(attach_thresholds(days, thresholds(readings, EVENTS), EVENTS))


@query(
    "daily_selfjoin",
    f"""SELECT k AS event_type, CAST(d AS VARCHAR) AS date, round(avg(v), 4) AS value,
          round(max(v), 4) AS value_max
        FROM ({EVENT_READINGS}) GROUP BY k, d""",
)
def _(spark, sf):
    return emit(daily_selfjoin(event_readings(spark, sf), EVENTS))


@query(
    "sorted_daily",
    f"""SELECT k AS event_type, CAST(d AS VARCHAR) AS date, round(avg(v), 4) AS value,
          round(max(v), 4) AS value_max
        FROM ({EVENT_READINGS}) GROUP BY k, d ORDER BY k, d""",
)
def _(spark, sf):
    return emit(sorted_daily(daily_slim(event_readings(spark, sf), EVENTS), EVENTS))


# --- thresholds and flags ------------------------------------------------------------------


@query(
    "threshold_raw",
    f"""SELECT k AS event_type, round(avg(v) + 1.5 * stddev_samp(v), 4) AS event_threshold
        FROM ({EVENT_READINGS}) GROUP BY k""",
)
def _(spark, sf):
    return emit(thresholds(event_readings(spark, sf), EVENTS))


@query(
    "threshold_raw_nan",
    f"""SELECT k AS o_orderpriority, round(avg(v) + 0.5 * stddev_samp(v), 4) AS event_threshold
        FROM ({PENDING_READINGS}) GROUP BY k""",
)
def _(spark, sf):
    return emit(thresholds(pending_orders_unread(spark, sf), ORDERS, stds=0.5))


@query(
    "threshold_raw_merged",
    f"""SELECT k AS o_orderpriority, round(avg(v) + 1.5 * stddev_samp(v), 4) AS event_threshold
        FROM ({PENDING_READINGS}) GROUP BY k""",
)
def _(spark, sf):
    daily = daily_rollup(pending_orders_unread(spark, sf), ORDERS, moments=True)
    return emit(reading_thresholds(daily, ORDERS))


@query(
    "threshold_daily",
    f"""WITH daily AS (SELECT k, d, avg(v) AS v FROM ({ORDER_READINGS}) GROUP BY k, d)
        SELECT k AS o_orderpriority, round(avg(v) + 1.5 * stddev_samp(v), 4) AS event_threshold
        FROM daily GROUP BY k""",
)
def _(spark, sf):
    return emit(thresholds(daily_slim(order_readings(spark, sf), ORDERS), ORDERS))


@query(
    "threshold_external",
    f"""WITH daily AS (SELECT k, d, max(v) AS vmax FROM ({ORDER_READINGS}) GROUP BY k, d),
        given AS (SELECT o_orderpriority AS k, median(o_totalprice) AS t FROM orders
                  WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
        SELECT daily.k AS o_orderpriority, CAST(d AS VARCHAR) AS date,
          CAST(coalesce(vmax > t, FALSE) AS INTEGER) AS event
        FROM daily LEFT JOIN given ON daily.k = given.k""",
)
def _(spark, sf):
    readings = order_readings(spark, sf)
    given = (
        readings.filter(F.col("o_orderpriority") != "5-LOW")
        .groupBy("o_orderpriority")
        .agg(F.median("o_totalprice").alias(ORDERS.threshold))
    )
    return emit(flagged_daily(readings, ORDERS, table=given).select("o_orderpriority", "date", "event"))


_FLAG_SQL = """
SELECT k AS o_orderpriority, CAST(d AS VARCHAR) AS date, round(vmax, 4) AS o_totalprice_max,
  round(thr, 4) AS event_threshold, flag AS event FROM f"""
_FLAG_COLUMNS = ["o_orderpriority", "date", "o_totalprice_max", "event_threshold", "event"]


@query("event_flag", series_ctes(PENDING_READINGS) + _FLAG_SQL)
def _(spark, sf):
    readings = pending_orders_unread(spark, sf)
    daily = daily_slim(readings, ORDERS)
    flagged = flag_events(attach_thresholds(daily, thresholds(readings, ORDERS), ORDERS), ORDERS)
    return emit(flagged.select(*_FLAG_COLUMNS))


@query("event_flag_own_raw", series_ctes(PENDING_READINGS) + _FLAG_SQL)
def _(spark, sf):
    return emit(flagged_daily(pending_orders_unread(spark, sf), ORDERS).select(*_FLAG_COLUMNS))


@query("event_flag_own_daily", series_ctes(PENDING_READINGS, basis="daily") + _FLAG_SQL)
def _(spark, sf):
    flagged = flagged_daily(pending_orders_unread(spark, sf), ORDERS, basis="daily")
    return emit(flagged.select(*_FLAG_COLUMNS))


# --- rolling features -----------------------------------------------------------------------


def _rolling(name: str, column: str, sql_column: str) -> None:
    sql = series_ctes(PENDING_READINGS) + f"""
SELECT k AS o_orderpriority, CAST(d AS VARCHAR) AS date, round({sql_column}, 4) AS {column} FROM f"""

    @query(name, sql)
    def _(spark, sf):
        daily = daily_slim(pending_orders_unread(spark, sf), ORDERS)
        return emit(add_features(daily, ORDERS, [column]).select("o_orderpriority", "date", column))


_rolling("rolling_mean_3", ORDERS.mean_3, "m3")
_rolling("rolling_mean_7", ORDERS.mean_7, "m7")
_rolling("rolling_std_7", ORDERS.spread, "s7")


@query(
    "features",
    series_ctes(EVENT_READINGS)
    + """
SELECT k AS event_type, CAST(d AS VARCHAR) AS date, round(v, 4) AS value, round(vmax, 4) AS value_max,
  round(m3, 4) AS value_3d_mean, round(m7, 4) AS value_7d_mean, round(s7, 4) AS value_std FROM f""",
)
def _(spark, sf):
    return emit(add_features(daily_slim(event_readings(spark, sf), EVENTS), EVENTS))


@query(
    "row_position",
    series_ctes(ORDER_READINGS)
    + """
SELECT k AS o_orderpriority, CAST(d AS VARCHAR) AS date, CAST(rn - 1 AS INTEGER) AS position FROM f""",
)
def _(spark, sf):
    daily = daily_slim(order_readings(spark, sf), ORDERS)
    return emit(row_position(daily, ORDERS).select("o_orderpriority", "date", "position"))


# --- entity filters --------------------------------------------------------------------------


@query(
    "split_entities",
    """SELECT CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'train' ELSE 'test' END AS split,
         event_id, event_type FROM events
       WHERE event_type IN ('click', 'purchase', 'view', 'error', 'signup')""",
)
def _(spark, sf):
    train, test = split_entities(
        event_readings(spark, sf).select("event_id", "event_type"), EVENTS_TRAIN, EVENTS_TEST, EVENTS
    )
    marked = [train.withColumn("split", F.lit("train")), test.withColumn("split", F.lit("test"))]
    return emit(marked[0].unionByName(marked[1]))


@query(
    "semi_entities",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(spark, sf):
    customers = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    listing = customers.select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return emit(keep_listed_entities(orders, listing, SensorColumns(entity="o_custkey")))


@query("distinct_keys", "SELECT DISTINCT o_orderpriority FROM orders")
def _(spark, sf):
    return order_readings(spark, sf).select("o_orderpriority").distinct()


@query(
    "union_entities",
    """SELECT event_type FROM events WHERE event_type IN ('click', 'purchase', 'view')
       UNION ALL SELECT event_type FROM events WHERE event_type IN ('error', 'signup', 'view')""",
)
def _(spark, sf):
    names = event_readings(spark, sf).select("event_type")
    return union_entities(
        keep_entities(names, EVENTS_TRAIN, EVENTS), keep_entities(names, (*EVENTS_TEST, "view"), EVENTS)
    )


@query(
    "preview_per_key",
    """SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(value, 4) AS value FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
       WHERE rn <= 5""",
)
def _(spark, sf):
    first = preview_per_key(event_readings(spark, sf), EVENTS, tie_breaker=["event_id"])
    return emit(first.select("event_type", "ts", "value"))


@query(
    "run_summary",
    """SELECT 'readings' AS "table", count(*) AS "rows" FROM events
       UNION ALL SELECT 'days', count(*) FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) FROM events)
       UNION ALL SELECT 'entities', count(DISTINCT event_type) FROM events""",
)
def _(spark, sf):
    """Readings, days and entities, all counted by the one plan that finds the entities."""
    tables = CountedTables()
    days = tables.counted("days", daily_slim(tables.counted("readings", event_readings(spark, sf)), EVENTS))
    tables.counted("entities", days.select("event_type").distinct()).write.format("noop").mode("overwrite").save()
    return tables.summary(spark)


_REFRESHED = """WITH days AS (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS v, max(value) AS top, count(value) AS n FROM events GROUP BY 1, 2),
thr AS (SELECT event_type, avg(value) + 1.5 * stddev_samp(value) AS thr FROM events GROUP BY 1)
SELECT event_type, CAST(d AS VARCHAR) AS date, round(v, 4) AS value, round(top, 4) AS value_max, CAST(n AS BIGINT) AS reading_count,
  round(thr, 4) AS event_threshold FROM days JOIN thr USING (event_type)"""


@query("daily_refreshed", _REFRESHED)
def _(spark, sf):
    """Days and thresholds after three batches; every batch has readings of every day, and the
    second one is applied twice."""
    readings = event_readings(spark, sf)
    store = DailyStore(spark, scratch_path(spark, "daily-store"), EVENTS)
    for batch in (0, 1, 1, 2):
        store.refresh(readings.where(F.col("event_id") % 3 == batch), batch)
    days = store.daily().join(store.thresholds(), "event_type")
    return emit(days.select("event_type", "date", "value", "value_max", "reading_count", "event_threshold"))


# --- scalar functions ------------------------------------------------------------------------


@query(
    "daynum_to_ts",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS decoded FROM events""",
)
def _(spark, sf):
    daynum = whole_seconds("ts") / 86400.0 + UNIX_EPOCH_DAYNUM
    coded = event_readings(spark, sf).select("event_id", daynum.alias("t"))
    return emit(coded.select("event_id", daynum_to_timestamp("t", to_seconds=True).alias("decoded")))


@query(
    "composite_key",
    """SELECT o_orderkey, o_orderpriority || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|'
         || CAST(CAST(o_orderdate AS DATE) + 7 AS VARCHAR) AS key FROM orders""",
)
def _(spark, sf):
    day = F.to_date("o_orderdate")
    key = composite_key("o_orderpriority", day, F.date_add(day, 7))
    return table(spark, sf, "orders").select("o_orderkey", key.alias("key"))
