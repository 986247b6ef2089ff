"""User scorers over whole horizons: blocks, shapes, scaler and stored tables."""

import math

import numpy as np
import oracle
import pytest
from fixtures import S, days, reading, readings

from gauge_engine.catalog import ORACLES, QUERIES
from gauge_engine.operators.daily import daily_slim
from gauge_engine.operators.index import index_with_ids
from gauge_engine.operators.models import BoostingSettings, ModelBundle
from gauge_engine.operators.plugin import score_horizon_with
from gauge_engine.operators.scaling import apply_scaler, apply_scaler_flat
from gauge_engine.plans.forecast import (
    fit_horizon_bundle,
    fit_scorer_bundle,
    forecast_horizon_with,
    score_horizon_bundle,
    scorer_training_windows,
)
from gauge_engine.plans.training import scoring_windows, training_windows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def waves(spark):
    rows = [reading(s, d, math.sin(i / 9 + k) * 3 + (i * (k + 3)) % 5) for k, s in enumerate("abc") for i, d in enumerate(days(60))]
    return readings(spark, rows).cache()


def last_step():
    return lambda blocks: np.repeat(blocks[:, -1, :1], 14, axis=1) + np.arange(14)


def test_blocks_arrive_as_rows_steps_features(spark, waves):
    windows = scoring_windows(waves, S, S.sequence_features, layout="matrix")
    want = {(r.station_name, r.hist_start): r.x[-1][0] for r in windows.collect()}
    got = {(r.station_name, r.hist_start): r.probs for r in score_horizon_with(windows, last_step(), S).collect()}
    assert set(got) == set(want) and len(want) > 100
    assert all(got[k] == pytest.approx([want[k] + i for i in range(14)]) for k in want)


@pytest.mark.parametrize(
    ("scorer", "message"),
    [
        (lambda b: np.zeros(len(b)), "14 probabilities"),
        (lambda b: np.zeros((len(b), 13)), "14 probabilities"),
        (lambda b: np.zeros((len(b) + 1, 14)), "14 probabilities"),
        (lambda b: np.full((len(b), 14), np.nan), "missing or infinite"),
    ],
)
def test_wrong_answers_fail(spark, waves, scorer, message):
    windows = scoring_windows(waves, S, S.sequence_features, layout="matrix")
    with pytest.raises(Exception, match=message):
        score_horizon_with(windows, scorer, S).collect()


def test_blocks_of_another_shape_fail(spark, waves):
    three = scoring_windows(waves, S, S.tree_features, layout="matrix")
    with pytest.raises(Exception, match="not 7 steps of 4 features"):
        score_horizon_with(three, last_step(), S).collect()
    with pytest.raises(Exception, match="not 6 steps"):
        score_horizon_with(three, last_step(), S, S.tree_features, history=6).collect()


def test_null_features_reach_the_scorer_as_nan(spark):
    df = spark.createDataFrame([("a", 1, 2, [[1.0, None]] * 7)], "station_name string, hist_start int, future_start int, x array<array<double>>")
    found = score_horizon_with(df, lambda b: np.isnan(b).sum(axis=(1, 2))[:, None] + np.zeros((1, 14)), S, ["p", "q"])
    assert found.first().probs == [7.0] * 14
    assert score_horizon_with(df.limit(0), last_step(), S, ["p", "q"]).collect() == []


def test_scaling_flat_blocks_equals_scaling_matrices(spark, waves):
    scaler = fit_scorer_bundle(waves, S).scaler
    flat = apply_scaler_flat(scoring_windows(waves, S, S.sequence_features), scaler, 4)
    matrix = apply_scaler(scoring_windows(waves, S, S.sequence_features, layout="matrix"), scaler)
    want = {(r.station_name, r.hist_start): [v for step in r.x for v in step] for r in matrix.collect()}
    assert {(r.station_name, r.hist_start): r.x for r in flat.collect()} == want
    values = np.array(list(want.values())).reshape(-1, 4)
    assert values.mean(axis=0) == pytest.approx([0] * 4, abs=1e-9) and values.std(axis=0) == pytest.approx([1] * 4)


def test_scaler_and_thresholds_are_stored(spark, waves, tmp_path):
    path = str(tmp_path / "scorer")
    index = index_with_ids(daily_slim(waves, S), S)
    one = forecast_horizon_with(last_step(), waves, waves, index, S, bundle_path=path)
    stored = ModelBundle.load(spark, path)
    fresh = fit_scorer_bundle(waves, S)
    assert stored.model is None and stored.kind == "scorer" and list(stored.features) == list(S.sequence_features)
    assert stored.scaler.collect() == fresh.scaler.collect()
    assert sorted(stored.thresholds.collect()) == sorted(fresh.thresholds.collect())
    two = forecast_horizon_with(last_step(), waves, waves, index, S, bundle_path=path)
    assert sorted(one.collect()) == sorted(two.collect())
    with pytest.raises(ValueError, match="stds"):
        forecast_horizon_with(last_step(), waves, waves, index, S, stds=2.0, bundle_path=path)
    with pytest.raises(ValueError, match="combine"):
        forecast_horizon_with(last_step(), waves, waves, index, S, combine="mean")


def test_a_scorer_fits_on_the_scaled_training_windows(spark, waves):
    bundle = fit_scorer_bundle(waves, S)
    rows = scorer_training_windows(bundle, waves, S).collect()
    own = {(r.station_name, r.hist_start): (r.y, r.y_days) for r in training_windows(waves, S, S.sequence_features, layout="matrix").collect()}
    assert {(r.station_name, r.hist_start): (r.y, r.y_days) for r in rows} == own
    assert np.array([r.x for r in rows]).shape == (len(own), 7, 4)


def test_horizon_bundles_keep_scaler_and_thresholds(spark, waves, tmp_path):
    bundle = fit_horizon_bundle(waves, S, settings=BoostingSettings(rounds=2, depth=2, rate=0.3))
    path = str(tmp_path / "horizon")
    bundle.save(spark, path)
    again = ModelBundle.load(spark, path)
    assert again.scaler.count() == 1 and again.thresholds.count() == 3
    windows = scoring_windows(waves, S, S.sequence_features)
    rows = score_horizon_bundle(bundle, windows, S).collect()
    assert sorted(rows) == sorted(score_horizon_bundle(again, windows, S).collect())
    assert len({p for r in rows for p in r.probs}) > 1


@pytest.mark.parametrize("name", ["plugin_horizon", "plugin_horizon_max"])
def test_queries_match_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) == []
