"""Readings to labelled or unlabelled windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gauge_engine.columns import HISTORY_DAYS, HORIZON_DAYS, STATIONS, THRESHOLD_STDS, SensorColumns
from gauge_engine.operators.daily import add_features, daily_rollup
from gauge_engine.operators.segments import HOME, SEGMENT, own_rows, split_into_segments
from gauge_engine.operators.thresholds import (
    add_own_threshold,
    attach_thresholds,
    flag_events,
    reading_thresholds,
    thresholds,
)
from gauge_engine.operators.windows import sliding_windows
from gauge_engine.session import materialize


def flag_series(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    table: DataFrame | None = None,
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
) -> DataFrame:
    """Daily series with threshold and event flag.

    Without a threshold ``table`` each entity uses its own; the raw basis then needs the
    daily moments.
    """
    if table is not None:
        return flag_events(attach_thresholds(daily, table, cols), cols)
    return flag_events(add_own_threshold(daily, cols, stds, basis), cols)


def flagged_daily(
    readings: DataFrame,
    cols: SensorColumns = STATIONS,
    table: DataFrame | None = None,
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
) -> DataFrame:
    """The same from readings, in a single scan."""
    moments = table is None and basis == "raw"
    return flag_series(daily_rollup(readings, cols, attrs=(), moments=moments), cols, table, stds, basis)


def windows_of(
    flagged: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    layout: str = "flat",
    drop_last: bool = False,
    guard_nulls: bool = True,
) -> DataFrame:
    """Labelled windows of a flagged daily series."""
    names = cols.tree_features if features is None else features
    return sliding_windows(
        add_features(flagged, cols, names),
        cols,
        names,
        labels=True,
        layout=layout,
        drop_last=drop_last,
        guard_nulls=guard_nulls,
    )


def training_windows(
    readings: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    table: DataFrame | None = None,
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
    layout: str = "flat",
    drop_last: bool = False,
    guard_nulls: bool = True,
) -> DataFrame:
    """Labelled windows: two shuffles in all (by entity and day, then by entity)."""
    flagged = flagged_daily(readings, cols, table, stds, basis)
    return windows_of(flagged, cols, features, layout, drop_last, guard_nulls)


def _segment_windows(
    daily: DataFrame,
    cols: SensorColumns,
    names: Sequence[str],
    segment_rows: int,
    labels: bool,
    layout: str,
    drop_last: bool,
    guard_nulls: bool,
) -> DataFrame:
    """Windows of a daily series whose entities are worked on in overlapping segments."""
    split = [SEGMENT]
    after = HISTORY_DAYS + HORIZON_DAYS - 1 + (1 if drop_last else 0)
    segments = add_features(split_into_segments(daily, cols, segment_rows, after=after), cols, names, split)
    windows = sliding_windows(
        segments,
        cols,
        names,
        labels=labels,
        layout=layout,
        drop_last=drop_last,
        guard_nulls=guard_nulls,
        split=split,
        keep=[SEGMENT, HOME],
    )
    return own_rows(windows)


def training_windows_segmented(
    readings: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
    segment_rows: int = 4096,
    layout: str = "flat",
    table: DataFrame | None = None,
    drop_last: bool = False,
    guard_nulls: bool = True,
) -> DataFrame:
    """The same windows for few, very long series: work is split below the entity.

    Thresholds come from ``table``, or from partially aggregated tables instead of a
    whole-entity frame. The daily table feeds several branches, so it is written once.
    """
    names = cols.tree_features if features is None else features
    daily = materialize(daily_rollup(readings, cols, attrs=(), moments=table is None), "daily")
    if table is None:
        table = series_thresholds(daily, cols, stds, basis)
    flagged = flag_events(attach_thresholds(daily, table, cols), cols)
    return _segment_windows(flagged, cols, names, segment_rows, True, layout, drop_last, guard_nulls)


def scoring_windows_segmented(
    readings: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    layout: str = "flat",
    segment_rows: int = 4096,
) -> DataFrame:
    """Unlabelled windows of few, very long series."""
    names = cols.tree_features if features is None else features
    daily = materialize(daily_rollup(readings, cols, attrs=()), "daily")
    return _segment_windows(daily, cols, names, segment_rows, False, layout, False, True)


def scoring_windows(
    readings: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    layout: str = "flat",
) -> DataFrame:
    """Unlabelled windows for scoring."""
    names = cols.tree_features if features is None else features
    daily = add_features(daily_rollup(readings, cols, attrs=()), cols, names)
    return sliding_windows(daily, cols, names, layout=layout)


def series_thresholds(
    daily: DataFrame, cols: SensorColumns = STATIONS, stds: float = THRESHOLD_STDS, basis: str = "raw"
) -> DataFrame:
    """Threshold table of a daily series on either basis; the raw one needs the moments."""
    return (reading_thresholds if basis == "raw" else thresholds)(daily, cols, stds)
