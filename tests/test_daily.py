from datetime import date

import pytest
from fixtures import NAN, S, days, features_of, reading, readings, series

from gauge_engine.operators.daily import add_features, daily_rollup, daily_selfjoin, daily_slim, daily_tumbling
from gauge_engine.operators.thresholds import (
    add_own_threshold,
    attach_thresholds,
    flag_events,
    reading_thresholds,
    thresholds,
)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_rollup_skips_nan_and_null_and_keeps_empty_days(spark):
    d1, d2 = days(2)
    df = readings(
        spark,
        [
            reading("a", d1, NAN, 0, None),
            reading("a", d1, 2.0, 1, 7.0),
            reading("a", d1, None, 2, 8.0),
            reading("a", d1, 4.0, 3, 9.0),
            reading("a", d2, NAN),
        ],
    )
    got = daily_rollup(df, S).orderBy("date").collect()
    assert [(r.sea_level, r.sea_level_max, r.latitude) for r in got] == [(3.0, 4.0, 7.0), (None, None, 1.0)]


def test_rows_without_station_or_time_belong_to_no_series(spark):
    (day,) = days(1)
    df = readings(spark, [reading("a", day, 1.0), reading(None, day, 9.0), (None, "a", 1.0, 2.0, 9.0)])
    assert [r.sea_level for r in daily_rollup(df, S).collect()] == [1.0]
    assert daily_tumbling(df, S).count() == 1 and daily_selfjoin(df, S).count() == 1
    assert [r.station_name for r in thresholds(df, S).collect()] == ["a"]


def test_only_observed_days(spark):
    df = readings(spark, [reading("a", d, 1.0) for i, d in enumerate(days(10)) if i not in (4, 5)])
    assert daily_slim(df, S).count() == 8
    assert daily_tumbling(df, S).count() == 8


def test_selfjoin_equals_rollup(spark):
    df = readings(spark, [reading(s, d, float(h * i), h) for s in "ab" for i, d in enumerate(days(5)) for h in range(4)])
    columns = ["station_name", "date", "sea_level", "sea_level_max"]
    assert rows(daily_selfjoin(df, S).select(columns), *columns) == rows(daily_slim(df, S).select(columns), *columns)


def test_rolling_skips_nulls(spark):
    values = [1.0, None, None, None, 5.0]
    got = add_features(daily_slim(series(spark, "a", values), S), S).orderBy("date").collect()
    assert [r.sea_level_3d_mean for r in got] == [1.0, 1.0, 1.0, None, 5.0]
    # Only the window of 7 rows still holds two values on the last day.
    assert [round(r.sea_level_std, 6) for r in got] == [0.0, 0.0, 0.0, 0.0, round(8**0.5, 6)]


def test_seven_null_days_empty_the_mean_on_the_seventh_only(spark):
    values = [1.0] * 3 + [None] * 7 + [2.0] * 3
    got = add_features(daily_slim(series(spark, "a", values), S), S).orderBy("date").collect()
    assert [i for i, r in enumerate(got) if r.sea_level_7d_mean is None] == [9]
    assert all(got[i].sea_level_std == 0.0 for i in range(3, 10))


def test_rolling_against_brute_force(spark):
    values = [float((i * 37) % 11) if i % 5 else None for i in range(40)]
    got = add_features(daily_slim(series(spark, "a", values), S), S).orderBy("date").collect()
    for r, want in zip(got, features_of(values)):
        assert (r.sea_level, r.sea_level_3d_mean, r.sea_level_7d_mean, r.sea_level_std) == pytest.approx(want)


def test_one_reading_has_no_threshold_and_no_event(spark):
    df = series(spark, "a", [3.0])
    assert thresholds(df, S).first().flood_threshold is None
    own = flag_events(add_own_threshold(daily_rollup(df, S, moments=True), S), S).first()
    assert own.flood_threshold is None and own.flood == 0


def test_station_without_threshold_has_no_event(spark):
    df = series(spark, "a", [3.0, 9.0])
    table = spark.createDataFrame([("b", 1.0)], "station_name string, flood_threshold double")
    got = flag_events(attach_thresholds(daily_slim(df, S), table, S), S).collect()
    assert [r.flood for r in got] == [0, 0]


def test_own_thresholds_equal_the_tables(spark):
    rows_ = [reading(s, d, NAN if (i + h) % 5 == 0 else float(i * h % 13), h) for s in "ab" for i, d in enumerate(days(9)) for h in range(i % 4 + 1)]
    df = readings(spark, rows_)
    daily = daily_rollup(df, S, moments=True)
    raw = {r.station_name: r.flood_threshold for r in thresholds(df, S).collect()}
    assert {r.station_name: r.flood_threshold for r in reading_thresholds(daily, S).collect()} == pytest.approx(raw)
    by_day = {r.station_name: r.flood_threshold for r in thresholds(daily, S).collect()}
    own = add_own_threshold(daily, S, basis="daily").select("station_name", "flood_threshold").distinct()
    assert {r.station_name: r.flood_threshold for r in own.collect()} == pytest.approx(by_day)
    assert raw != pytest.approx(by_day)
    with pytest.raises(ValueError):
        add_own_threshold(daily, S, basis="weekly")


def test_flag_is_strict(spark):
    df = series(spark, "a", [1.0, 2.0, 3.0], date(2021, 1, 1))
    table = spark.createDataFrame([("a", 2.0)], "station_name string, flood_threshold double")
    got = flag_events(attach_thresholds(daily_slim(df, S), table, S), S).orderBy("date").collect()
    assert [r.flood for r in got] == [0, 0, 1]
