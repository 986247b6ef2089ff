"""The given tables in the roles of sensor readings, and the same roles as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gauge_engine.catalog.registry import table
from gauge_engine.columns import SensorColumns

# Events: dense series (every entity has readings every day) with an attribute to carry.
EVENTS = SensorColumns("event_type", "ts", "value", ("user_id",), threshold="event_threshold", flag="event")
EVENTS_TRAIN = ("click", "purchase", "view")
EVENTS_TEST = ("error", "signup")

# Orders: long series with missing days.
ORDERS = SensorColumns(
    "o_orderpriority", "o_orderdate", "o_totalprice", (), threshold="event_threshold", flag="event"
)
ORDERS_TRAIN = ("1-URGENT", "2-HIGH", "3-MEDIUM")
ORDERS_TEST = ("4-NOT SPECIFIED", "5-LOW")

# Orders by status: fewer, denser series for whole intervals.
STATUS = SensorColumns(
    "o_orderstatus", "o_orderdate", "o_totalprice", (), threshold="event_threshold", flag="event"
)
STATUS_TEST = ("F", "O")


def event_readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "event_type", "ts", "value", "user_id")


def order_readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")


def status_readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")


def pending_orders_unread(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose reading is NaN while they are pending: whole days can be unread."""
    price = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderdate", price.alias("o_totalprice")
    )


def saturated_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose reading is NaN beyond the sensor's range."""
    value = F.when(F.col("value") > 150, F.lit(float("nan"))).otherwise(F.col("value"))
    return event_readings(spark, sf).withColumn("value", value)


def whole_seconds(ts: str) -> Column:
    """Seconds since 1970 of a zone-free time, fractions cut; independent of the session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01"))
    return days.cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def week_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Seven-day intervals from the data: every calendar week with an order."""
    start = F.to_date(F.date_trunc("week", "o_orderdate"))
    weeks = table(spark, sf, "orders").select(start.alias("start_date")).distinct()
    return weeks.select("start_date", F.date_add("start_date", 6).alias("end_date"))


# --- SQL ---------------------------------------------------------------------------------

ORDER_READINGS = "SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders"
PENDING_READINGS = (
    "SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS d,"
    " CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v FROM orders"
)
STATUS_READINGS = "SELECT o_orderstatus AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders"
EVENT_READINGS = "SELECT event_type AS k, CAST(ts AS DATE) AS d, value AS v FROM events"


def series_ctes(readings: str, where: str = "TRUE", stds: float = 1.5, basis: str = "raw") -> str:
    """CTEs: readings r, daily series, thresholds, flagged and featured days (f)."""
    source = "r" if basis == "raw" else "daily"
    return f"""
WITH r AS (SELECT * FROM ({readings}) WHERE {where}),
daily AS (SELECT k, d, avg(v) AS v, max(v) AS vmax FROM r GROUP BY k, d),
thr AS (SELECT k, avg(v) + {stds} * stddev_samp(v) AS thr FROM {source} GROUP BY k),
f AS (
  SELECT daily.*, thr.thr,
    CAST(coalesce(vmax > thr.thr, FALSE) AS INTEGER) AS flag,
    row_number() OVER w AS rn,
    count(*) OVER (PARTITION BY daily.k) AS n,
    avg(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
    avg(v) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7,
    coalesce(stddev_samp(v) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS s7
  FROM daily LEFT JOIN thr ON daily.k = thr.k
  WINDOW w AS (PARTITION BY daily.k ORDER BY d)
)"""


def window_ctes(readings: str, features: tuple[str, ...] = ("v", "m3", "m7"), guard: bool = True,
                drop_last: bool = False, **series: object) -> str:
    """Adds w: one row per window with its labels, found by joining row numbers."""
    any_null = " OR ".join(f"h.{c} IS NULL" for c in features)
    having = f"HAVING sum(CAST(h.rn BETWEEN a.rn AND a.rn + 6 AND ({any_null}) AS INTEGER)) = 0" if guard else ""
    reach = 21 if drop_last else 20
    return series_ctes(readings, **series) + f""",
w AS (
  SELECT a.k, a.rn, a.d AS hist_start,
    max(h.d) FILTER (WHERE h.rn = a.rn + 7) AS future_start,
    CAST(max(h.flag) FILTER (WHERE h.rn >= a.rn + 7) AS INTEGER) AS y,
    string_agg(CAST(h.flag AS VARCHAR), ',' ORDER BY h.rn) FILTER (WHERE h.rn >= a.rn + 7) AS y_days
  FROM f a JOIN f h ON h.k = a.k AND h.rn BETWEEN a.rn AND a.rn + 20
  WHERE a.rn + {reach} <= a.n
  GROUP BY a.k, a.rn, a.d {having}
)"""


def block_rows(features: tuple[str, ...] = ("v", "m3", "m7")) -> str:
    """CTE b: one row per window and position of its flat block."""
    width = len(features)
    parts = [
        f"SELECT w.k, w.rn, w.hist_start, w.future_start, CAST((h.rn - w.rn) * {width} + {i} AS INTEGER) AS pos,"
        f" h.{c} AS x FROM w JOIN f h ON h.k = w.k AND h.rn BETWEEN w.rn AND w.rn + 6"
        for i, c in enumerate(features)
    ]
    return ",\nb AS (" + "\nUNION ALL ".join(parts) + ")"
