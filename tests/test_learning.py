import math

import numpy as np
import pytest
from fixtures import S, days, reading, readings

from gauge_engine.columns import SensorColumns
from pyspark.sql import functions as F

from gauge_engine.functions.arrays import horizon_blend, horizon_max, horizon_weights
from gauge_engine.functions.scalars import binarize, composite_key, sigmoid
from gauge_engine.operators.daily import daily_slim
from gauge_engine.operators.index import index_with_ids
from gauge_engine.operators import models
from gauge_engine.operators.models import (
    BoostingSettings,
    ModelBundle,
    fit_boosting,
    fit_then_refit,
    load_or_fit,
    score_windows,
)
from gauge_engine.operators.plugin import score_with
from gauge_engine.operators.splits import split_random, split_stratified, split_tail
from gauge_engine.plans.evaluate import evaluation_report, score_predictions
from gauge_engine.plans.forecast import NO_WINDOWS, forecast, forecast_horizon, forecast_with, publish_forecast
from gauge_engine.plans.prepare import prepare_dataset
from gauge_engine.plans.training import scoring_windows, training_windows
from gauge_engine.sources.readers import read_index, read_predictions, read_readings

QUICK = BoostingSettings(rounds=2, rate=0.3, depth=2)


def waves(spark, stations, n=120):
    rows = [reading(s, d, math.sin(i / 9 + k) * 3 + (i * (k + 3)) % 5 / 5) for k, s in enumerate(stations) for i, d in enumerate(days(n))]
    return readings(spark, rows)


@pytest.fixture(scope="module")
def train(spark):
    return waves(spark, "abc").cache()


@pytest.fixture(scope="module")
def test(spark):
    return waves(spark, "yz").cache()


def test_stratified_sizes_and_repeatability(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    marked = split_stratified(df, ["id"])
    counts = {(r.y, r.is_validation): r["count"] for r in marked.groupBy("y", "is_validation").count().collect()}
    assert counts == {(0, True): 180, (0, False): 720, (1, True): 20, (1, False): 80}
    again = split_stratified(df.repartition(5), ["id"]).filter("is_validation")
    assert {r.id for r in marked.filter("is_validation").collect()} == {r.id for r in again.collect()}
    other = split_stratified(df, ["id"], seed=7).filter("is_validation")
    assert {r.id for r in again.collect()} != {r.id for r in other.collect()}


@pytest.mark.parametrize(("n", "marked"), [(0, 0), (9, 0), (10, 1), (257, 25)])
def test_random_split_sizes(spark, n, marked):
    assert split_random(spark.range(n), ["id"]).filter("is_validation").count() == marked


def test_one_class_is_still_split(spark):
    df = spark.range(11).withColumn("y", F.lit(0))
    assert split_stratified(df, ["id"]).filter("is_validation").count() == 3


def test_tail_takes_the_last_windows(spark):
    df = spark.createDataFrame([(s, d) for s in "ba" for d in days(15)], "station_name string, hist_start date")
    got = split_tail(df, ["hist_start"], cols=S).filter("is_validation").collect()
    assert sorted((r.station_name, r.hist_start) for r in got) == [("b", d) for d in days(15)[-3:]]


def test_horizon_functions(spark):
    assert horizon_weights(14)[0] == 0.5 and horizon_weights(14)[-1] == 1.5
    assert sum(horizon_weights(14)) == pytest.approx(14)
    probs = [0.3] * 14
    rising = [i / 20 for i in range(14)]
    df = spark.createDataFrame([(probs,), (rising,)], "p array<double>")
    got = df.select(horizon_blend("p").alias("b"), horizon_max("p").alias("m")).collect()
    assert got[0].b == pytest.approx(0.3) and got[0].m == 0.3
    want = 0.6 * np.average(rising, weights=np.linspace(0.5, 1.5, 14)) + 0.4 * max(rising)
    assert got[1].b == pytest.approx(want)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (None,), (float("nan"),)], "p double")
    got = df.select(binarize("p").alias("a"), binarize("p", strict=True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 0), (0, 0), (0, 0), (0, 0)]
    assert df.limit(1).select(sigmoid(F.lit(0.0)).alias("s")).first().s == 0.5
    key = spark.createDataFrame([("a", days(1)[0])], "s string, d date").select(composite_key("s", "d", "d").alias("k"))
    assert key.first().k == "a|2020-01-01|2020-01-01"


def test_boosting_learns_and_reports(train, test):
    windows = training_windows(train, S, stds=0.5)
    model = fit_boosting(windows, QUICK)
    scored = {n: score_windows(model, training_windows(df, S, stds=0.5)).select("y", "y_prob") for n, df in (("train", train), ("test", test))}
    report = {r.split: r for r in evaluation_report(**scored).collect()}
    assert set(report) == {"train", "test"} and report["train"].n == 300
    assert report["train"].auc > 0.8


def test_bundle_is_reused(spark, train, test, tmp_path):
    path = str(tmp_path / "bundle")
    calls = []

    def fit():
        calls.append(1)
        windows = training_windows(train, S, stds=0.5)
        table = spark.createDataFrame([("a", 1.0)], "station_name string, flood_threshold double")
        return ModelBundle(fit_boosting(windows, QUICK), S.tree_features, QUICK, thresholds=table)

    first = load_or_fit(spark, path, fit)
    second = load_or_fit(spark, path, fit)
    assert calls == [1] and second.settings == QUICK and list(second.features) == list(S.tree_features)
    assert second.thresholds.first().flood_threshold == 1.0 and second.scaler is None
    windows = scoring_windows(test, S)
    a, b = (score_windows(m.model, windows).orderBy("station_name", "hist_start").select("y_prob").collect() for m in (first, second))
    assert a == b and all(0 <= r.y_prob <= 1 for r in a)


def test_refit_uses_the_chosen_rounds(train):
    marked = split_stratified(training_windows(train, S, stds=0.5), ["station_name", "hist_start"])
    assert fit_then_refit(marked, "is_validation", QUICK).getNumTrees <= QUICK.rounds
    assert fit_then_refit(marked, "is_validation", QUICK, use_best_rounds=False).getNumTrees == QUICK.rounds


@pytest.mark.parametrize("sorted_rows", [10_000, 1_000_000])
def test_rounds_are_scored_on_every_held_out_row(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(models, "SORTED_ROWS", sorted_rows)
    n = 200_500
    rows = spark.range(n).select(
        F.array(((F.col("id") * 7919) % 10_007).cast("double")).alias("x"), ((F.col("id") * 104_729) % 1009 < F.col("id") / 400).cast("int").alias("y")
    )
    model = fit_boosting(rows.limit(2000), QUICK)
    got = models.round_metrics(model, rows).orderBy("iter").toPandas()
    scored = score_windows(model, rows).select("y", "y_prob").toPandas()
    loss = -np.log(np.where(scored.y == 1, scored.y_prob, 1 - scored.y_prob)).mean()
    by_prob = scored.groupby("y_prob").y.agg(["sum", "size"])
    neg = by_prob["size"] - by_prob["sum"]
    wins = (by_prob["sum"] * (neg.cumsum() - neg / 2)).sum()
    assert list(got.iter) == [0, 1] and len(scored) == n
    assert got.Logloss[1] == pytest.approx(loss, rel=1e-9)
    assert got.AUC[1] == pytest.approx(wins / (by_prob["sum"].sum() * neg.sum()), rel=1e-12)


def test_rounds_of_one_class_or_no_rows(spark):
    rows = spark.range(40).select(F.array(F.col("id").cast("double")).alias("x"), (F.col("id") > 20).cast("int").alias("y"))
    model = fit_boosting(rows, QUICK)
    assert [r.AUC for r in models.round_metrics(model, rows.where("y = 0")).collect()] == [0.5, 0.5]
    assert models.round_metrics(model, rows.limit(0)).count() == 0


def test_forecast_answers_every_id(spark, train, test, tmp_path):
    index = index_with_ids(daily_slim(test, S), S)
    got = forecast(train, test, index, S, settings=QUICK, stds=0.5, bundle_path=str(tmp_path / "m")).collect()
    assert sorted(r.id for r in got) == list(range(index.count()))
    assert all(0 <= r.y_prob <= 1 for r in got) and len({r.y_prob for r in got}) > 1
    with pytest.raises(ValueError, match=NO_WINDOWS):
        forecast(train, test.limit(0), index, S, settings=QUICK, stds=0.5, bundle_path=str(tmp_path / "m"))


def test_a_bundle_of_another_kind_is_refused(spark, train, test, tmp_path):
    index, path = index_with_ids(daily_slim(test, S), S), str(tmp_path / "m")
    forecast(train, test, index, S, settings=QUICK, stds=0.5, bundle_path=path)
    with pytest.raises(ValueError, match="has stds"):
        forecast(train, test, index, S, settings=QUICK, bundle_path=path)
    with pytest.raises(ValueError, match="has kind"):
        forecast_horizon(train, test, index, S, settings=QUICK, stds=0.5, bundle_path=path)


def test_from_matrix_to_scores_through_files(spark, tmp_path):
    wide = spark.range(24 * 60).select(
        (F.col("id") / 24 + 719529.0).alias("t"),
        *[(F.sin(F.col("id") / (40.0 + k)) * 3).alias(name) for k, name in enumerate("abcyz")],
    )
    cols = SensorColumns(attrs=())
    path = str(tmp_path)
    prepare_dataset(wide, train="abc", test="yz", cols=cols, to_seconds=True).write(path)
    train, test = (read_readings(spark, f"{path}/{part}", cols) for part in ("train", "test"))
    index = read_index(spark, f"{path}/index", cols)
    assert index.count() == 2 * 40
    assert publish_forecast(index, lambda: forecast(train, test, index, cols, settings=QUICK), f"{path}/out")
    predictions = read_predictions(spark, f"{path}/out")
    labelled = training_windows(test, cols).select("station_name", "hist_start", "future_start", "y")
    truth = index.join(labelled, ["station_name", "hist_start", "future_start"]).select("id", F.col("y").alias("y_true"))
    assert score_predictions(truth, predictions).first().n == 80


def test_failing_prediction_leaves_the_constant_table(spark, tmp_path):
    index = spark.range(5)

    def fails_when_run():
        return index.select("id", F.raise_error(F.lit("no")).cast("double").alias("y_prob"))

    def fails_at_once():
        raise RuntimeError("no model")

    for i, predict in enumerate((fails_when_run, fails_at_once)):
        assert not publish_forecast(index, predict, str(tmp_path / str(i)))
        assert {r.y_prob for r in read_predictions(spark, str(tmp_path / str(i))).collect()} == {0.5}


def test_horizon_forecast_answers_every_id(train, test):
    index = index_with_ids(daily_slim(test, S), S)
    got = forecast_horizon(train, test, index, S, settings=QUICK, stds=0.5).collect()
    assert sorted(r.id for r in got) == list(range(len(got))) and all(0 <= r.y_prob <= 1 for r in got)
    with pytest.raises(ValueError, match="combine"):
        forecast_horizon(train, test, index, S, combine="mean")


def test_plugin_scores_rows_in_batches(spark, test):
    def last_value(matrix):
        return matrix[:, -1]

    index = index_with_ids(daily_slim(test, S), S)
    windows = scoring_windows(test, S)
    want = {(r.station_name, r.hist_start): r.x[-1] for r in windows.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = score_with(windows, last_value, S).collect()
        assert {(r.station_name, r.hist_start): r.y_prob for r in got} == want
        assert forecast_with(last_value, test, index, S).count() == index.count()
        with pytest.raises(Exception, match="one probability per row"):
            score_with(windows, lambda m: m, S).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_horizon_rows_are_dealt_by_what_the_fit_passes_over(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_PER_TASK", 100)
    seen = []
    monkeypatch.setattr(models, "_fit", lambda rows, settings, label: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    windows = spark.range(50).select(F.array(F.col("id").cast("double")).alias("x"), F.array_repeat(F.lit(1), 14).alias("y_days"))
    models.fit_horizon(windows.union(windows.selectExpr("x", "CAST(NULL AS array<int>)").limit(1)))
    models.fit_horizon(windows.limit(0))
    models.fit_boosting(windows.withColumn("y", F.lit(1)))
    assert seen == [(7, 700), (1, 0), (1, 50)]
