"""Readings to daily series, and rolling features over the observed days.

The rollup groups by (entity, day) with map-side partial aggregation, so an entity that
holds a large share of the readings is spread over its days. Afterwards an entity has at
most one row per calendar day - about 36,500 rows for a century - whatever the volume of
readings; that is the bound on every per-entity window in this package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gauge_engine.columns import STATIONS, SensorColumns
from gauge_engine.functions.scalars import null_if_nan

READING_COUNT = "reading_count"
READING_SQUARES = "reading_squares"


def _earliest_known(attr: str, time: str) -> Column:
    """Value at the earliest time at which it is known; the smallest one of that time."""
    known_at = F.when(F.col(attr).isNotNull(), F.struct(time, attr))
    return F.min_by(F.col(attr), known_at)


def known_readings(readings: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """Readings that name their entity and time; the others belong to no series."""
    return readings.filter(F.col(cols.entity).isNotNull() & F.col(cols.time).isNotNull())


def daily_rollup(
    readings: DataFrame,
    cols: SensorColumns = STATIONS,
    attrs: Sequence[str] | None = None,
    moments: bool = False,
) -> DataFrame:
    """One row per entity and observed day: mean, maximum and carried attributes.

    ``moments`` also keeps the count of readings and their sum of squared deviations from
    the day's mean, from which reading-level thresholds follow without a second scan.
    """
    carried = cols.attrs if attrs is None else attrs
    measure = null_if_nan(cols.value)
    aggs = [F.avg(measure).alias(cols.value), F.max(measure).alias(cols.peak)]
    aggs += [_earliest_known(a, cols.time).alias(a) for a in carried]
    if moments:
        aggs += [
            F.count(measure).alias(READING_COUNT),
            (F.var_pop(measure) * F.count(measure)).alias(READING_SQUARES),
        ]
    days = F.to_date(cols.time).alias(cols.date)
    return known_readings(readings, cols).groupBy(cols.entity, days).agg(*aggs)


def daily_slim(readings: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """Mean and maximum only, as index building needs."""
    return daily_rollup(readings, cols, attrs=())


def daily_tumbling(readings: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """The same days through one-day tumbling buckets; here too only observed days appear."""
    measure = null_if_nan(cols.value)
    return (
        known_readings(readings, cols)
        .groupBy(cols.entity, F.window(cols.time, "1 day").alias("bucket"))
        .agg(F.avg(measure).alias(cols.value), F.max(measure).alias(cols.peak))
        .withColumn(cols.date, F.to_date("bucket.start"))
        .drop("bucket")
    )


def daily_selfjoin(readings: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """Mean and maximum as two rollups joined on entity and day.

    Kept for callers that hold the two tables apart; :func:`daily_rollup` gives the same
    rows from one aggregate and is what every plan here uses.
    """
    measure = null_if_nan(cols.value)
    keys = [F.col(cols.entity), F.to_date(cols.time).alias(cols.date)]
    known = known_readings(readings, cols)
    means = known.groupBy(*keys).agg(F.avg(measure).alias(cols.value))
    peaks = known.groupBy(*keys).agg(F.max(measure).alias(cols.peak))
    return means.join(peaks, [cols.entity, cols.date])


def series_window(cols: SensorColumns, split: Sequence[str] = ()) -> WindowSpec:
    """Observed days of an entity in date order; ``split`` adds segment keys."""
    return Window.partitionBy(cols.entity, *split).orderBy(cols.date)


def rolling_mean(cols: SensorColumns, rows: int, split: Sequence[str] = ()) -> Column:
    """Mean of the last ``rows`` observed days, shorter at the start, nulls skipped."""
    return F.avg(cols.value).over(series_window(cols, split).rowsBetween(1 - rows, 0))


def rolling_std(cols: SensorColumns, rows: int, split: Sequence[str] = ()) -> Column:
    """Sample deviation of the last ``rows`` observed days; 0 where undefined."""
    spread = F.stddev_samp(cols.value).over(series_window(cols, split).rowsBetween(1 - rows, 0))
    return F.coalesce(spread, F.lit(0.0))


def add_features(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    split: Sequence[str] = (),
) -> DataFrame:
    """Add the rolling columns among ``features``; one sort serves every frame."""
    wanted = cols.sequence_features if features is None else features
    known = {
        cols.mean_3: lambda: rolling_mean(cols, 3, split),
        cols.mean_7: lambda: rolling_mean(cols, 7, split),
        cols.spread: lambda: rolling_std(cols, 7, split),
    }
    return daily.withColumns({f: known[f]() for f in wanted if f in known})


def whole_series(cols: SensorColumns) -> WindowSpec:
    """All rows of an entity, ordered like the sliding frames so that one sort serves both."""
    return series_window(cols).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def row_position(daily: DataFrame, cols: SensorColumns = STATIONS, name: str = "position") -> DataFrame:
    """0-based position of each observed day inside its entity."""
    return daily.withColumn(name, F.row_number().over(series_window(cols)) - 1)


def preview_per_key(
    readings: DataFrame, cols: SensorColumns = STATIONS, rows: int = 5, tie_breaker: Sequence[str] = ()
) -> DataFrame:
    """The first ``rows`` readings of each entity (Spark limits each group before the shuffle)."""
    w = Window.partitionBy(cols.entity).orderBy(cols.time, *tie_breaker)
    return readings.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= rows).drop("_rank")


def sorted_daily(daily: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """Total order by entity and day, for sinks."""
    return daily.orderBy(cols.entity, cols.date)
