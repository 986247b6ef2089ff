"""Feature scaling over the steps of all windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import HISTORY_DAYS, HORIZON_DAYS, STATIONS, SensorColumns
from gauge_engine.functions.arrays import flatten_block, reshape_block, scale_block
from gauge_engine.operators.daily import series_window
from gauge_engine.operators.windows import _any_null, _last_row_date


def window_membership(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
    name: str = "in_windows",
) -> DataFrame:
    """How many valid windows hold each day in their history."""
    names = cols.sequence_features if features is None else features
    w = series_window(cols)
    nulls = F.sum(_any_null(names).cast("int")).over(w.rowsBetween(0, history - 1))
    exists = _last_row_date(cols, history, horizon, False, ()).isNotNull()
    opened = daily.withColumn("_opens", (exists & (nulls == 0)).cast("int"))
    return opened.withColumn(name, F.sum("_opens").over(w.rowsBetween(1 - history, 0))).drop("_opens")


def fit_scaler(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
) -> DataFrame:
    """One row: ``mean`` and ``std`` arrays in feature order over all steps of all windows.

    A day counts once per window that holds it, so days are weighted instead of being
    repeated seven times. The deviation is the population one and is centred on the mean
    (a second pass over the small daily table) to stay accurate; 0 becomes 1.
    """
    names = cols.sequence_features if features is None else features
    weight = F.col("in_windows").cast("double")
    days = window_membership(daily, cols, names, history, horizon).filter(F.col("in_windows") > 0)
    means = days.agg(
        F.array(*[F.sum(weight * F.col(f)) / F.sum(weight) for f in names]).alias("mean")
    )
    centred = days.withColumn("_mean", means.scalar())
    variances = [
        F.sum(weight * F.pow(F.col(f) - F.col("_mean")[i], 2)) / F.sum(weight)
        for i, f in enumerate(names)
    ]
    stds = [F.when(v == 0, F.lit(1.0)).otherwise(F.sqrt(v)) for v in variances]
    return centred.agg(F.max("_mean").alias("mean"), F.array(*stds).alias("std"))


def apply_scaler(windows: DataFrame, scaler: DataFrame, block: str = "x") -> DataFrame:
    """Standardise matrix blocks with a one-row scaler table."""
    fitted = windows.withColumns(
        {"_mean": scaler.select("mean").scalar(), "_std": scaler.select("std").scalar()}
    )
    return fitted.withColumn(block, scale_block(block, "_mean", "_std")).drop("_mean", "_std")


def apply_scaler_flat(windows: DataFrame, scaler: DataFrame, width: int, block: str = "x") -> DataFrame:
    """The same for flat blocks of steps of ``width`` features."""
    scaled = apply_scaler(windows.withColumn(block, reshape_block(block, width)), scaler, block)
    return scaled.withColumn(block, flatten_block(block))
