from datetime import timedelta

import pytest
from fixtures import S, START, days, reading, readings
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gauge_engine.columns import INTERVALS_SCHEMA
from gauge_engine.operators.daily import add_features, daily_slim
from gauge_engine.operators.intervals import interval_history, interval_truth
from gauge_engine.operators.logs import best_iteration, early_stop
from gauge_engine.operators.thresholds import attach_thresholds, flag_events
from gauge_engine.plans.evaluate import evaluate_intervals
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def daily(spark):
    rows = []
    for i, d in enumerate(days(60)):
        rows.append(reading("a", d, float(i % 9)))
        if i not in (3, 45):
            rows.append(reading("b", d, float(i % 5)))
        rows.append(reading("other", d, 1.0))
    table = spark.createDataFrame([("a", 6.0), ("b", 3.0)], "station_name string, flood_threshold double")
    flagged = flag_events(attach_thresholds(daily_slim(readings(spark, rows), S), table, S), S)
    return add_features(flagged, S, S.tree_features)


def intervals(spark, *starts):
    rows = [(START + timedelta(days=s), START + timedelta(days=s + 6)) for s in starts]
    df = spark.createDataFrame(rows, INTERVALS_SCHEMA).coalesce(1)
    return df.withColumn("window_idx", F.monotonically_increasing_id().cast("int"))


def test_history_needs_every_day_and_keeps_duplicates(spark, daily):
    windows = intervals(spark, 0, 10, 10, 500)
    got = interval_history(daily, windows, ["a", "b"], S)
    assert sorted((r.window_idx, r.station_name) for r in got.collect()) == [
        (0, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")]
    block = got.filter("window_idx = 1 AND station_name = 'a'").first().x
    assert block[0::3] == [float((10 + i) % 9) for i in range(7)] and len(block) == 21


def test_truth_pads_incomplete_horizons_with_zeros(spark, daily):
    windows = intervals(spark, 10, 30, 500)
    got = {(r.window_idx, r.station_name): r.y_days for r in interval_truth(daily, windows, ["a", "b", "absent"], S).collect()}
    assert set(got) == {(0, "a"), (0, "b"), (1, "a"), (1, "b")}
    assert got[0, "a"] == [int((17 + i) % 9 > 6) for i in range(14)]
    # Day 45 is missing for b, so 13 of 14 days are not enough.
    assert got[1, "b"] == [0] * 14 and sum(got[1, "a"]) > 0


def test_evaluation(spark, daily):
    truth = interval_truth(daily, intervals(spark, 10, 20), ["a", "b"], S)
    perfect = truth.select("window_idx", "station_name", F.transform("y_days", lambda y: y * 0.9).alias("probs"))
    got = evaluate_intervals(truth, perfect, S).collect()
    assert {r.window_idx for r in got} == {0, 1, None} and {r.acc for r in got} == {1.0}


def brute_stop(values, patience):
    best, waited, at = float("inf"), 0, None
    for i, v in enumerate(values):
        if v < best:
            best, waited, at = v, 0, i
        else:
            waited += 1
        if waited >= patience:
            return i, at, best
    return None, at, best


@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=25), min_size=20, max_size=40), st.integers(1, 5))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_early_stop_against_brute_force(spark, runs, patience):
    rows = [(run, i, float(v)) for run, values in enumerate(runs) for i, v in enumerate(values)]
    log = spark.createDataFrame(rows, "run int, iter int, Logloss double")
    got = {r.run: (r.stop_iter, r.best_iter, r.best_value) for r in early_stop(log, "run", patience=patience).collect()}
    assert got == {run: brute_stop([float(v) for v in values], patience) for run, values in enumerate(runs)}


def test_best_iteration_takes_the_earliest(spark):
    log = spark.createDataFrame(
        [("r", 0, 0.5), ("r", 1, 0.9), ("r", 2, 0.9), ("r", 3, float("nan"))], "run string, iter int, AUC double")
    assert tuple(best_iteration(log, "run").first()) == ("r", 1, 0.9)
    assert best_iteration(log, "run", larger_is_better=False).first().best_iter == 0
