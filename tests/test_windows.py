import pytest
from fixtures import NAN, S, days, features_of, reading, readings, series
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gauge_engine.functions.arrays import reshape_block
from gauge_engine.operators.daily import add_features, daily_slim
from gauge_engine.operators.scaling import apply_scaler, fit_scaler
from gauge_engine.operators.segments import row_ordinals
from gauge_engine.operators.windows import window_anchors
from gauge_engine.plans.training import scoring_windows, training_windows, training_windows_segmented


def brute_windows(values, threshold, history=7, horizon=14, width=3):
    feats = features_of(values)
    out = []
    for i in range(len(values) - history - horizon + 1):
        block = [x for step in feats[i : i + history] for x in step[:width]]
        if any(x is None for x in block):
            continue
        flags = [int(v is not None and v > threshold) for v in values[i + history : i + history + horizon]]
        out.append((i, block, flags))
    return out


def table(spark, threshold):
    return spark.createDataFrame([("a", threshold)], "station_name string, flood_threshold double")


@pytest.mark.parametrize(("n", "full", "dropped"), [(20, 0, 0), (21, 1, 0), (22, 2, 1)])
def test_short_series(spark, n, full, dropped):
    daily = daily_slim(series(spark, "a", [1.0] * n), S)
    assert window_anchors(daily, S).count() == full
    assert window_anchors(daily, S, drop_last=True).count() == dropped
    assert scoring_windows(series(spark, "a", [1.0] * n), S).count() == full


def test_rows_cross_a_gap(spark):
    kept = [d for i, d in enumerate(days(33)) if i not in (10, 11, 12)]
    df = readings(spark, [reading("a", d, float(i)) for i, d in enumerate(kept)])
    got = scoring_windows(df, S).orderBy("hist_start").collect()
    assert len(got) == 10
    assert [(r.hist_start, r.future_start) for r in got] == [(kept[i], kept[i + 7]) for i in range(10)]


def test_null_day_in_history_drops_in_future_stays(spark):
    values = [float(i % 5) for i in range(30)]
    values[15] = None
    got = training_windows(series(spark, "a", values), S, table=table(spark, 3.0)).orderBy("hist_start").collect()
    want = brute_windows(values, 3.0)
    assert [(r.hist_start, r.y_days) for r in got] == [(days(30)[i], f) for i, _, f in want]
    assert {i for i, _, _ in want} == set(range(10)) - {9}


@given(st.lists(st.one_of(st.none(), st.floats(0, 10)), min_size=0, max_size=45))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_against_brute_force(spark, values):
    df = series(spark, "a", [NAN if v is None else v for v in values])
    got = training_windows(df, S, S.sequence_features, table=table(spark, 5.0)).orderBy("hist_start").collect()
    want = brute_windows(values, 5.0, width=4)
    assert [r.hist_start for r in got] == [days(45)[i] for i, _, _ in want]
    for r, (_, block, flags) in zip(got, want):
        assert r.x == pytest.approx(block, abs=1e-6)
        assert r.y_days == flags and r.y == max(flags)


@pytest.mark.parametrize("rows", [21, 25, 64])
def test_segments_give_the_same_windows(spark, rows):
    data = []
    for k, station in enumerate("abc"):
        for i, d in enumerate(days(80 + 17 * k)):
            if (i + k) % 11:
                data.append(reading(station, d, NAN if i % 23 == 0 else float((i * (k + 3)) % 17)))
    df = readings(spark, data)
    order = ["station_name", "hist_start"]
    whole = training_windows(df, S, S.sequence_features).orderBy(order).collect()
    split = training_windows_segmented(df, S, S.sequence_features, segment_rows=rows).orderBy(order).collect()
    assert len(whole) > 50 and len(whole) == len(split)
    for a, b in zip(whole, split):
        assert (a.station_name, a.hist_start, a.future_start, a.y, a.y_days) == (
            b.station_name, b.hist_start, b.future_start, b.y, b.y_days)
        assert a.x == pytest.approx(b.x)


def test_segment_must_exceed_its_overlap(spark):
    with pytest.raises(ValueError):
        training_windows_segmented(series(spark, "a", [1.0]), S, segment_rows=20)


def test_ordinals(spark):
    daily = daily_slim(series(spark, "a", [1.0] * 70), S)
    got = row_ordinals(daily, S).orderBy("date").collect()
    assert [r.ordinal for r in got] == list(range(70))


def test_layouts_hold_the_same_numbers(spark):
    df = series(spark, "a", [float(i) for i in range(24)])
    flat = scoring_windows(df, S).orderBy("hist_start")
    matrix = scoring_windows(df, S, layout="matrix").orderBy("hist_start").collect()
    back = flat.select(reshape_block("x", 3).alias("m")).collect()
    assert [r.m for r in back] == [r.x for r in matrix]
    with pytest.raises(ValueError):
        scoring_windows(df, S, layout="cube")


def test_scaler_against_repeated_days(spark):
    values = [float((i * 7) % 10) if i % 9 else None for i in range(60)]
    df = series(spark, "a", values)
    daily = add_features(daily_slim(df, S), S)
    scaler = fit_scaler(daily, S)
    got = scaler.first()
    blocks = [b for _, b, _ in brute_windows(values, 0.0, width=4)]
    for j in range(4):
        xs = [x for b in blocks for x in b[j::4]]
        mean = sum(xs) / len(xs)
        std = (sum((x - mean) ** 2 for x in xs) / len(xs)) ** 0.5
        assert (got["mean"][j], got["std"][j]) == pytest.approx((mean, std))
    scaled = apply_scaler(scoring_windows(df, S, S.sequence_features, layout="matrix"), scaler)
    steps = [step for r in scaled.collect() for step in r.x]
    for j in range(4):
        assert sum(s[j] for s in steps) / len(steps) == pytest.approx(0, abs=1e-9)


def test_scaler_of_constants_divides_by_one(spark):
    got = fit_scaler(add_features(daily_slim(series(spark, "a", [4.0] * 25), S), S), S).first()
    assert got["std"] == [1.0] * 4
