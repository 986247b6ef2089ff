"""Sliding history/horizon windows over the observed days of each entity.

Frames count rows, not calendar days: a window simply spans a gap. All frames share one
window specification, so the daily series is shuffled by entity once and sorted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import HISTORY_DAYS, HORIZON_DAYS, STATIONS, SensorColumns
from gauge_engine.functions.arrays import flatten_block
from gauge_engine.operators.daily import series_window


def _any_null(features: Sequence[str]) -> Column:
    flag = F.lit(False)
    for f in features:
        flag = flag | F.col(f).isNull()
    return flag


def _last_row_date(
    cols: SensorColumns, history: int, horizon: int, drop_last: bool, split: Sequence[str]
) -> Column:
    """Date of the row that must still exist for an anchor to be valid."""
    reach = history + horizon - 1 + (1 if drop_last else 0)
    return F.lead(cols.date, reach).over(series_window(cols, split))


def window_anchors(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
    drop_last: bool = False,
) -> DataFrame:
    """Days that can open a window: the whole history and the whole horizon must follow.

    ``drop_last`` leaves out the final anchor of every entity.
    """
    w = series_window(cols)
    return (
        daily.withColumns(
            {
                "future_start": F.lead(cols.date, history).over(w),
                "_last": _last_row_date(cols, history, horizon, drop_last, ()),
            }
        )
        .filter(F.col("_last").isNotNull())
        .select(cols.entity, F.col(cols.date).alias("hist_start"), "future_start")
    )


def sliding_windows(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
    labels: bool = False,
    layout: str = "flat",
    drop_last: bool = False,
    guard_nulls: bool = True,
    split: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """History blocks with their dates and, with ``labels``, the horizon's event flags.

    ``layout`` is ``'flat'`` (one time-major vector) or ``'matrix'`` (steps of features).
    A block with any null feature is left out unless ``guard_nulls`` is off. Future rows
    must exist even without labels, so labelled and unlabelled windows line up.
    """
    if layout not in ("flat", "matrix"):
        raise ValueError(f"layout must be 'flat' or 'matrix', not {layout!r}")
    names = cols.tree_features if features is None else features
    w = series_window(cols, split)
    past = w.rowsBetween(0, history - 1)
    future = w.rowsBetween(history, history + horizon - 1)

    added = {
        "future_start": F.lead(cols.date, history).over(w),
        "_last": _last_row_date(cols, history, horizon, drop_last, split),
        "_nulls": F.sum(_any_null(names).cast("int")).over(past),
        # The inner array is never null, so null features keep their slot.
        "_block": F.collect_list(F.array(*[F.col(f) for f in names])).over(past),
    }
    if labels:
        added["y"] = F.max(cols.flag).over(future)
        added["y_days"] = F.collect_list(cols.flag).over(future)

    found = daily.withColumns(added).filter(F.col("_last").isNotNull())
    if guard_nulls:
        found = found.filter(F.col("_nulls") == 0)
    x = flatten_block("_block") if layout == "flat" else F.col("_block")
    out = [
        F.col(cols.entity),
        F.col(cols.date).alias("hist_start"),
        F.col("future_start"),
        x.alias("x"),
    ]
    if labels:
        out += [F.col("y"), F.col("y_days")]
    return found.select(*out, *keep)
