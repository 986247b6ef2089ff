"""Calendar test index: which (entity, anchor day) pairs have to be predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import HISTORY_DAYS, HORIZON_DAYS, STATIONS, SensorColumns
from gauge_engine.operators.daily import whole_series
from gauge_engine.operators.ordering import with_dense_id


def calendar_index(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
) -> DataFrame:
    """One row per observed day whose history and horizon lie inside the entity's dates.

    The bounds are calendar dates, so days inside them may be missing; row windows that do
    not line up with such an anchor simply find no match later.
    """
    whole = whole_series(cols)
    anchor = F.col(cols.date)
    return (
        daily.select(
            cols.entity,
            cols.date,
            F.min(cols.date).over(whole).alias("_first"),
            F.max(cols.date).over(whole).alias("_last"),
        )
        .filter(
            (F.col("_first") <= F.date_sub(anchor, history))
            & (F.col("_last") >= F.date_add(anchor, horizon - 1))
        )
        .select(
            cols.entity,
            F.date_sub(anchor, history).alias("hist_start"),
            F.date_sub(anchor, 1).alias("hist_end"),
            anchor.alias("future_start"),
            F.date_add(anchor, horizon - 1).alias("future_end"),
        )
    )


def index_with_ids(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
) -> DataFrame:
    """The calendar index with dense ids in (entity, anchor) order."""
    index = with_dense_id(calendar_index(daily, cols, history, horizon), cols.entity, ["future_start"])
    return index.select("id", cols.entity, "hist_start", "hist_end", "future_start", "future_end")
