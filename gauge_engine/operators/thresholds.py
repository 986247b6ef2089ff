"""Event thresholds per entity and the daily event flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import STATIONS, THRESHOLD_STDS, SensorColumns
from gauge_engine.functions.scalars import event_flag, null_if_nan
from gauge_engine.operators.daily import READING_COUNT, READING_SQUARES, whole_series


def thresholds(
    series: DataFrame, cols: SensorColumns = STATIONS, stds: float = THRESHOLD_STDS
) -> DataFrame:
    """Mean plus ``stds`` sample deviations per entity.

    The basis is whatever ``series`` holds: raw readings or daily means (two different
    answers). An entity with one value has no deviation, hence a null threshold.
    """
    measure = null_if_nan(cols.value)
    rule = F.avg(measure) + stds * F.stddev_samp(measure)
    known = series.filter(F.col(cols.entity).isNotNull())
    return known.groupBy(cols.entity).agg(rule.alias(cols.threshold))


def add_own_threshold(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
) -> DataFrame:
    """Attach each entity's own threshold without a join or a second scan.

    ``basis='raw'`` merges the per-day moments (``daily_rollup(..., moments=True)``) into
    the reading-level mean and deviation; ``basis='daily'`` uses the daily means. Both are
    whole-entity frames on the partitioning the sliding windows need anyway.
    """
    whole = whole_series(cols)
    if basis == "daily":
        rule = F.avg(cols.value).over(whole) + stds * F.stddev_samp(cols.value).over(whole)
        return daily.withColumn(cols.threshold, rule)
    if basis != "raw":
        raise ValueError(f"basis must be 'raw' or 'daily', not {basis!r}")
    count = F.sum(READING_COUNT).over(whole)
    total = F.sum(F.col(READING_COUNT) * F.col(cols.value)).over(whole)
    centred = daily.withColumns({"_n": count, "_mean": total / F.nullif(count, F.lit(0))})
    between = F.col(READING_COUNT) * F.pow(F.col(cols.value) - F.col("_mean"), 2)
    squares = F.sum(F.col(READING_SQUARES) + between).over(whole)
    deviation = F.sqrt(squares / F.nullif(F.col("_n") - 1, F.lit(0)))
    return centred.withColumn(cols.threshold, F.col("_mean") + stds * deviation).drop("_n", "_mean")


def reading_thresholds(
    daily: DataFrame, cols: SensorColumns = STATIONS, stds: float = THRESHOLD_STDS
) -> DataFrame:
    """Reading-level thresholds as a table, merged from daily moments.

    Two partially aggregated passes over the daily table: the means first, then the
    squared deviations from them, so nothing cancels and no entity is gathered whole.
    """
    count, value = F.col(READING_COUNT), F.col(cols.value)
    means = daily.groupBy(cols.entity).agg(
        F.sum(count).alias("_n"), (F.sum(count * value) / F.nullif(F.sum(count), F.lit(0))).alias("_mean")
    )
    squares = F.sum(F.col(READING_SQUARES) + count * F.pow(value - F.col("_mean"), 2))
    deviation = F.sqrt(squares / F.nullif(F.max("_n") - 1, F.lit(0)))
    rule = F.max("_mean") + stds * deviation
    return daily.join(means, cols.entity).groupBy(cols.entity).agg(rule.alias(cols.threshold))


def attach_thresholds(daily: DataFrame, table: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """Left join of a threshold table; an unknown entity keeps a null threshold.

    No broadcast is forced: the table has a row per entity, so Spark decides by its size.
    """
    return daily.join(table.select(cols.entity, cols.threshold), cols.entity, "left")


def flag_events(daily: DataFrame, cols: SensorColumns = STATIONS) -> DataFrame:
    """Add the 0/1 event flag from the day's peak and the attached threshold."""
    return daily.withColumn(cols.flag, event_flag(cols.peak, cols.threshold))
