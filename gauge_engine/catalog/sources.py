"""File sources and sinks (written from the given tables and read back), and the dataset plan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gauge_engine.catalog.registry import emit, query, table
from gauge_engine.catalog.stand_ins import (
    EVENTS,
    EVENTS_TEST,
    EVENTS_TRAIN,
    ORDER_READINGS,
    ORDERS,
    event_readings,
    order_readings,
    saturated_events,
    series_ctes,
    whole_seconds,
)
from gauge_engine.catalog.windows import _INDEX_COLUMNS, INDEX_CTE
from gauge_engine.functions.scalars import UNIX_EPOCH_DAYNUM
from gauge_engine.operators.daily import daily_slim
from gauge_engine.operators.index import index_with_ids
from gauge_engine.plans.prepare import prepare_dataset, prepare_listed
from gauge_engine.session import scratch_path
from gauge_engine.sources.matrix import melt_matrix
from gauge_engine.sources.readers import (
    read_index,
    read_predictions,
    read_entities,
    read_readings,
    read_readings_checked,
    read_truth,
    read_truth_checked,
)
from gauge_engine.sources.sinks import publish_predictions, write_table

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
    ]
)
_EVENT_SQL = """SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
  round(CASE WHEN value > 150 THEN NULL ELSE value END, 4) AS value FROM events"""


@query("csv_scan", _EVENT_SQL)
def _(spark, sf):
    path = scratch_path(spark, "readings")
    write_table(saturated_events(spark, sf), path)
    return emit(read_readings(spark, path, EVENTS, EVENT_SCHEMA))


@query("csv_sink", _EVENT_SQL)
def _(spark, sf):
    path = scratch_path(spark, "readings-by-entity")
    write_table(saturated_events(spark, sf), path, partition_by=["event_type"])
    read = read_readings(spark, path, EVENTS, EVENT_SCHEMA)
    return emit(read.select("event_id", "event_type", "ts", "value"))


@query("parquet_sink", _EVENT_SQL)
def _(spark, sf):
    path = scratch_path(spark, "readings-parquet")
    write_table(saturated_events(spark, sf), path, "parquet", ["event_type"])
    read = read_readings(spark, path, EVENTS, EVENT_SCHEMA, "parquet")
    return emit(read.select("event_id", "event_type", "ts", "value"))


@query(
    "index_scan",
    series_ctes(ORDER_READINGS) + INDEX_CTE + f"SELECT CAST(id AS BIGINT) AS id, {_INDEX_COLUMNS} FROM idx",
)
def _(spark, sf):
    path = scratch_path(spark, "index")
    write_table(index_with_ids(daily_slim(order_readings(spark, sf), ORDERS), ORDERS), path)
    return emit(read_index(spark, path, ORDERS))


@query(
    "truth_repair",
    "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS id, CAST(toxic AS INTEGER) AS y_true FROM labels",
)
def _(spark, sf):
    path = scratch_path(spark, "truth")
    write_table(table(spark, sf, "labels").orderBy("doc_id").select("quality", "toxic"), path)
    return read_truth(spark, path)


@query(
    "preds_scan",
    """SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey) - 1 AS BIGINT) AS id,
         round(l_discount * 10, 4) AS y_prob FROM lineitem""",
)
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    lines = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    write_table(lines.select((F.col("l_discount") * 10).alias("y_prob")), path)
    return emit(read_predictions(spark, path))


@query(
    "preds_contract",
    "SELECT l_orderkey * 10 + l_linenumber AS id, round(l_discount * 10, 4) AS y_prob FROM lineitem",
)
def _(spark, sf):
    path = scratch_path(spark, "published")
    id_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(id_.alias("id"), (F.col("l_discount") * 10).alias("y_prob"))
    publish_predictions(lines, path)
    return emit(read_predictions(spark, path))


@query(
    "csv_quarantine",
    """SELECT 'good' AS part, CAST(o_orderkey AS VARCHAR) AS id, CAST(CAST(o_totalprice > 250000 AS INTEGER) AS VARCHAR) AS y_true
       FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT 'quarantine', 'rangée ' || o_orderkey, CAST(CAST(o_totalprice > 250000 AS INTEGER) AS VARCHAR)
       FROM orders WHERE o_orderstatus = 'P'""",
)
def _(spark, sf):
    path = scratch_path(spark, "dirty-truth")
    key = F.col("o_orderkey").cast("string")
    dirty = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("rangée "), key)).otherwise(key)
    rows = table(spark, sf, "orders").select(
        dirty.alias("id"), (F.col("o_totalprice") > 250000).cast("int").alias("y_true")
    )
    write_table(rows, path, encoding="ISO-8859-1")
    good, bad = read_truth_checked(spark, path)
    text = [
        part.select(F.lit(name).alias("part"), F.col("id").cast("string").alias("id"),
                    F.col("y_true").cast("string").alias("y_true"))
        for name, part in (("good", good), ("quarantine", bad))
    ]
    return text[0].unionByName(text[1])


@query(
    "readings_quarantine",
    """SELECT 'good' AS part, event_id, round(value, 4) AS value, CAST(NULL AS VARCHAR) AS bad_line FROM events WHERE event_id % 7 <> 0
       UNION ALL SELECT 'quarantine', NULL, NULL, event_id || ',' || event_type || ',yesterday,1.5' FROM events WHERE event_id % 7 = 0""",
)
def _(spark, sf):
    path = scratch_path(spark, "dirty-readings")
    dirty = F.col("event_id") % 7 == 0
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = event_readings(spark, sf).select(
        "event_id", "event_type", F.when(dirty, "yesterday").otherwise(ts).alias("ts"),
        F.when(dirty, "1.5").otherwise(F.col("value").cast("string")).alias("value"),
    )
    write_table(rows, path)
    good, bad = read_readings_checked(spark, path, EVENTS, EVENT_SCHEMA)
    parts = good.select(F.lit("good").alias("part"), "event_id", "value").unionByName(
        bad.select(F.lit("quarantine").alias("part"), "bad_line"), allowMissingColumns=True
    )
    return emit(parts)


@query("entity_list", "SELECT DISTINCT event_type FROM events")
def _(spark, sf):
    path = scratch_path(spark, "entities")
    write_table(event_readings(spark, sf).select("event_type").distinct(), path)
    return read_entities(spark, path, EVENTS)


# --- wide matrix ---------------------------------------------------------------------------------


def hourly_matrix(spark, sf):
    """Hour by event type, as day-numbers and one column per entity; empty hours are null."""
    hour = F.floor(whole_seconds("ts") / 3600) / 24.0 + UNIX_EPOCH_DAYNUM
    names = [*EVENTS_TRAIN, *EVENTS_TEST]
    return event_readings(spark, sf).groupBy(hour.alias("t")).pivot("event_type", names).agg(F.avg("value"))


def entity_attributes(spark, sf):
    return event_readings(spark, sf).groupBy("event_type").agg(F.min("user_id").alias("user_id"))


_TALL = """WITH tall AS (
  SELECT hours.h AS ts, types.k, c.v FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) hours
  CROSS JOIN (SELECT DISTINCT event_type AS k FROM events) types
  LEFT JOIN (SELECT date_trunc('hour', ts) AS h, event_type AS k, avg(value) AS v FROM events GROUP BY 1, 2) c
    ON c.h = hours.h AND c.k = types.k)"""


@query(
    "melt_matrix",
    _TALL
    + """SELECT strftime(tall.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, k AS event_type, u.user_id, round(v, 4) AS value
         FROM tall JOIN (SELECT event_type, min(user_id) AS user_id FROM events GROUP BY 1) u ON u.event_type = k""",
)
def _(spark, sf):
    tall = melt_matrix(hourly_matrix(spark, sf), entity_attributes(spark, sf), EVENTS, to_seconds=True)
    return emit(tall)


_PREPARED_SQL = (
    _TALL
    + """, days AS (SELECT DISTINCT k, CAST(ts AS DATE) AS d FROM tall WHERE k IN ('error', 'signup')),
idx AS (SELECT row_number() OVER (ORDER BY k, d) - 1 AS id, k, d FROM
  (SELECT k, d, min(d) OVER (PARTITION BY k) AS first, max(d) OVER (PARTITION BY k) AS last FROM days)
  WHERE first <= d - 7 AND last >= d + 13)
SELECT CASE WHEN k IN ('error', 'signup') THEN 'test' ELSE 'train' END AS part, k AS event_type,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, round(v, 4) AS value, CAST(NULL AS BIGINT) AS id,
  CAST(NULL AS VARCHAR) AS hist_start, CAST(NULL AS VARCHAR) AS future_end FROM tall
UNION ALL SELECT 'index', k, strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f'), NULL, CAST(id AS BIGINT),
  CAST(d - 7 AS VARCHAR), CAST(d + 13 AS VARCHAR) FROM idx"""
)


@query("prepare_dataset", _PREPARED_SQL)
def _(spark, sf):
    return _prepared(prepare_dataset(
        hourly_matrix(spark, sf), entity_attributes(spark, sf), EVENTS_TRAIN, EVENTS_TEST, EVENTS, to_seconds=True
    ))


@query("prepare_listed", _PREPARED_SQL)
def _(spark, sf):
    """Entity lists from tables: which event types are tested is read from the data."""
    names = entity_attributes(spark, sf).select("event_type")
    tested = F.col("event_type").isin(*EVENTS_TEST)
    return _prepared(prepare_listed(
        hourly_matrix(spark, sf), names.where(~tested), names.where(tested), entity_attributes(spark, sf), EVENTS, to_seconds=True
    ))


def _prepared(made):
    columns = ["part", "event_type", "at", "value", "id", "hist_start", "future_end"]

    def part(df, name, at):
        return df.select("*", F.lit(name).alias("part"), F.col(at).cast("timestamp_ntz").alias("at"))

    parts = part(made.train, "train", "ts").unionByName(part(made.test, "test", "ts"))
    return emit(parts.unionByName(part(made.index, "index", "future_start"), allowMissingColumns=True).select(*columns))
