"""Model fitting, scoring and the whole forecast, on the orders series."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from gauge_engine.catalog.registry import emit, explode_block, query
from gauge_engine.catalog.horizon import _WEEKS, _weeks_from_file
from gauge_engine.catalog.stand_ins import (
    ORDER_READINGS,
    ORDERS,
    ORDERS_TEST,
    ORDERS_TRAIN,
    STATUS,
    STATUS_READINGS,
    STATUS_TEST,
    block_rows,
    order_readings,
    series_ctes,
    status_readings,
    window_ctes,
)
from gauge_engine.catalog.windows import FOUR, INDEX_CTE
from gauge_engine.operators.daily import add_features, daily_slim
from gauge_engine.operators.index import index_with_ids
from gauge_engine.operators.models import (
    VALIDATED_SETTINGS,
    BoostingSettings,
    ModelBundle,
    load_or_fit,
    score_windows,
    validated_fit,
)
from gauge_engine.operators.splits import split_entities, split_stratified
from gauge_engine.plans.evaluate import evaluate_interval_forecast, evaluation_report, score_predictions
from gauge_engine.plans.forecast import (
    fit_bundle,
    fit_horizon_bundle,
    forecast,
    forecast_horizon,
    forecast_horizon_with,
    forecast_with,
    score_horizon_bundle,
)
from gauge_engine.plans.training import flagged_daily, scoring_windows, training_windows
from gauge_engine.session import materialize, scratch_path, shared_folder

KEYS = ["o_orderpriority", "hist_start", "future_start"]


def _split(spark, sf):
    return split_entities(order_readings(spark, sf), ORDERS_TRAIN, ORDERS_TEST, ORDERS)


def _index(test):
    return index_with_ids(daily_slim(test, ORDERS), ORDERS)


def mean_level_scorer():
    """A fixed logistic rule on the block's mean, as a closure that travels by value."""

    def scorer(matrix: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(matrix.mean(axis=1) - 250000.0) / 50000.0))

    return scorer


@query(
    "plugin_score",
    window_ctes(ORDER_READINGS)
    + block_rows()
    + INDEX_CTE
    + """, s AS (SELECT k, hist_start, future_start, 1 / (1 + exp(-(avg(x) - 250000) / 50000)) AS p FROM b GROUP BY 1, 2, 3)
SELECT CAST(id AS BIGINT) AS id, round(coalesce(p, 0.5), 6) AS y_prob FROM idx
LEFT JOIN s ON idx.k = s.k AND idx.hist_start = s.hist_start AND idx.future_start = s.future_start""",
)
def _(spark, sf):
    readings = order_readings(spark, sf)
    return emit(forecast_with(mean_level_scorer(), readings, _index(readings), ORDERS), 6)


def rising_level_scorer():
    """A fixed horizon rule on scaled blocks: recent steps count more, later days rise."""

    def scorer(blocks: np.ndarray) -> np.ndarray:
        steps, days = np.arange(1, 8) / 28.0, np.arange(14)
        level = (blocks * steps[None, :, None]).sum(axis=1).mean(axis=1)
        return 1.0 / (1.0 + np.exp(-(level[:, None] + (days - 6) * 0.1)))

    return scorer


def _among(entities: tuple[str, ...]) -> str:
    return "k IN (" + ", ".join(f"'{e}'" for e in entities) + ")"


_SCALED_SQL = (
    window_ctes(ORDER_READINGS, FOUR, where=_among(ORDERS_TEST))
    + block_rows(FOUR)
    + INDEX_CTE
    + f""", fitted AS (SELECT pos % 4 AS j, avg(x) AS m, stddev_pop(x) AS sd FROM (
  {window_ctes(ORDER_READINGS, FOUR, where=_among(ORDERS_TRAIN)) + block_rows(FOUR)} SELECT pos, x FROM b) GROUP BY 1),
level AS (SELECT k, hist_start, future_start, sum((x - m) / sd * (pos // 4 + 1) / 28.0) / 4 AS v
  FROM b JOIN fitted ON b.pos % 4 = fitted.j GROUP BY 1, 2, 3),
p AS (SELECT k, hist_start, future_start, i, 1 / (1 + exp(-(v + (i - 6) * 0.1))) AS p FROM level, range(14) AS r(i)),
s AS (SELECT k, hist_start, future_start,
  0.6 * sum(p * (0.5 + i / 13.0)) / sum(0.5 + i / 13.0) + 0.4 * max(p) AS blend, max(p) AS top FROM p GROUP BY 1, 2, 3)
SELECT CAST(id AS BIGINT) AS id, round(coalesce(NAME, 0.5), 6) AS y_prob FROM idx
LEFT JOIN s ON idx.k = s.k AND idx.hist_start = s.hist_start AND idx.future_start = s.future_start"""
)


def _plugin_horizon(name: str, combine: str, column: str) -> None:
    @query(name, _SCALED_SQL.replace("NAME", column))
    def _(spark, sf):
        """A user's scorer for all days, on blocks scaled by the training entities."""
        train, test = _split(spark, sf)
        path = scratch_path(spark, "scorer")
        # The second call reads the scaler that the first one stored.
        for _ in range(2):
            answers = forecast_horizon_with(
                rising_level_scorer(), train, test, _index(test), ORDERS, combine=combine, bundle_path=path
            )
        return emit(answers, 6)


_plugin_horizon("plugin_horizon", "blend", "blend")
_plugin_horizon("plugin_horizon_max", "max", "top")


# --- what a fit determines: which windows and ids are answered, and probabilities -----------------

_TEST = window_ctes(ORDER_READINGS, where=f"k IN {ORDERS_TEST}")
_WINDOWS_SQL = _TEST + """
SELECT k AS o_orderpriority, CAST(hist_start AS VARCHAR) AS hist_start, CAST(future_start AS VARCHAR) AS future_start,
  1 AS is_probability, 1 AS varied FROM w"""
_IDS_SQL = _TEST + INDEX_CTE + """
SELECT CAST(id AS BIGINT) AS id, 1 AS is_probability, CAST(w.k IS NULL AS INTEGER) AS without_window
FROM idx LEFT JOIN w ON idx.k = w.k AND idx.hist_start = w.hist_start AND idx.future_start = w.future_start"""


def _is_probability(name: str):
    return F.col(name).between(0.0, 1.0).cast("int").alias("is_probability")


def _probabilities(scored, name, *columns):
    """Every row's probability, and whether the model tells rows apart at all."""
    written = materialize(scored, "scored")
    ends = written.agg((F.max(name) > F.min(name)).alias("varied")).scalar()
    return emit(written.select(*columns, _is_probability(name), ends.alias("varied")))


def _fitted(spark, sf, kind):
    """The path of a bundle fitted once per session and table folder, with all its rounds."""
    train, _ = _split(spark, sf)
    path = f"{shared_folder(spark)}/catalog-{spark.sparkContext.applicationId}-{kind}-{zlib.crc32(sf.encode())}"

    def fit():
        if kind == "horizon":
            return fit_horizon_bundle(train, ORDERS)
        return fit_bundle(train, ORDERS)

    features = ORDERS.sequence_features if kind == "horizon" else ORDERS.tree_features
    return path, load_or_fit(spark, path, fit, kind=kind, settings=BoostingSettings(), features=features)


@query("gbt_score", _WINDOWS_SQL)
def _(spark, sf):
    _, bundle = _fitted(spark, sf, "window")
    scored = score_windows(bundle.model, scoring_windows(_split(spark, sf)[1], ORDERS))
    return _probabilities(scored, "y_prob", *KEYS)


@query("gbt_reload", _WINDOWS_SQL.replace("1 AS is_probability, 1 AS varied", "1 AS same_as_before"))
def _(spark, sf):
    """A bundle saved again and read back scores like the one it came from."""
    _, bundle = _fitted(spark, sf, "window")
    path = scratch_path(spark, "bundle")
    bundle.save(spark, path)
    windows = materialize(scoring_windows(_split(spark, sf)[1], ORDERS), "test-windows")
    before = score_windows(bundle.model, windows).select(*KEYS, "y_prob")
    after = score_windows(ModelBundle.load(spark, path).model, windows).select(*KEYS, F.col("y_prob").alias("again"))
    return emit(before.join(after, KEYS).select(*KEYS, (F.col("y_prob") == F.col("again")).alias("same_as_before")))


@query("gbt_refit", _WINDOWS_SQL)
def _(spark, sf):
    train, test = _split(spark, sf)
    marked = split_stratified(training_windows(train, ORDERS), KEYS[:2])
    model = validated_fit(marked, "is_validation", VALIDATED_SETTINGS).model
    return _probabilities(score_windows(model, scoring_windows(test, ORDERS)), "y_prob", *KEYS)


@query(
    "horizon_forecast",
    _TEST + """
SELECT k AS o_orderpriority, CAST(hist_start AS VARCHAR) AS hist_start, CAST(future_start AS VARCHAR) AS future_start,
  CAST(h AS INTEGER) AS pos, 1 AS is_probability, 1 AS varied FROM w, range(14) AS r(h)""",
)
def _(spark, sf):
    _, bundle = _fitted(spark, sf, "horizon")
    windows = scoring_windows(_split(spark, sf)[1], ORDERS, ORDERS.sequence_features)
    scored = explode_block(score_horizon_bundle(bundle, windows, ORDERS), "probs")
    return _probabilities(scored, "x", *KEYS, "pos")


@query("horizon_pipeline", _IDS_SQL)
def _(spark, sf):
    path, _ = _fitted(spark, sf, "horizon")
    train, test = _split(spark, sf)
    return _answers(forecast_horizon(train, test, _index(test), ORDERS, bundle_path=path), test, ORDERS.sequence_features)


@query("forecast_pipeline", _IDS_SQL)
def _(spark, sf):
    path, _ = _fitted(spark, sf, "window")
    train, test = _split(spark, sf)
    return _answers(forecast(train, test, _index(test), ORDERS, bundle_path=path), test, ORDERS.tree_features)


def _answers(predictions, test, features):
    """Every id, whether it has a probability, and whether it has no window and so 0.5."""
    windows = scoring_windows(test, ORDERS, features).select(*KEYS, F.lit(True).alias("_has"))
    joined = _index(test).join(windows, KEYS, "left").join(predictions, "id")
    without = F.col("_has").isNull() & (F.col("y_prob") == 0.5)
    return emit(joined.select("id", _is_probability("y_prob"), without.alias("without_window")))


_REPORT_SQL = f"""SELECT 'train' AS split, CAST(count(*) AS BIGINT) AS n, 1 AS is_auc, 1 AS learned FROM (
  {window_ctes(ORDER_READINGS, where=_among(ORDERS_TRAIN))} SELECT * FROM w)
UNION ALL SELECT 'test', CAST(count(*) AS BIGINT), 1, NULL FROM (
  {_TEST + INDEX_CTE} SELECT id FROM idx JOIN w ON idx.k = w.k AND idx.hist_start = w.hist_start
  AND idx.future_start = w.future_start)"""


@query("eval_report", _REPORT_SQL)
def _(spark, sf):
    """Scores of the training fit, which it must have learned, and of truth joined to predictions
    for the test entities (n = 0 where no test id has a window)."""
    path, bundle = _fitted(spark, sf, "window")
    train, test = _split(spark, sf)
    fitted = score_windows(bundle.model, training_windows(train, ORDERS)).select("y", "y_prob")
    index = materialize(_index(test), "index")
    truth = training_windows(test, ORDERS).select(*KEYS, "y").join(index, KEYS).select("id", F.col("y").alias("y_true"))
    answers = forecast(train, test, index, ORDERS, bundle_path=path)
    tested = score_predictions(truth, answers, allow_empty=True)
    report = evaluation_report(train=fitted).unionByName(tested.withColumn("split", F.lit("test")))
    learned = F.when(F.col("split") == "train", F.col("auc") > 0.8).alias("learned")
    return emit(report.select("split", "n", F.col("auc").between(0.0, 1.0).alias("is_auc"), learned))


@query(
    "interval_forecast",
    series_ctes(STATUS_READINGS, stds=0.5)
    + _WEEKS
    + """SELECT CAST(i AS INTEGER) AS window_idx, CAST(count(*) AS BIGINT) AS cells, CAST(coalesce(sum(flag), 0) AS BIGINT) AS positives
         FROM truth JOIN (SELECT DISTINCT i AS hi, k AS hk FROM hist) ON i = hi AND k = hk GROUP BY ROLLUP (i)""",
)
def _(spark, sf):
    """Which days of which intervals are scored, and the events among them."""
    _, bundle = _fitted(spark, sf, "horizon")
    flagged = flagged_daily(status_readings(spark, sf), STATUS, stds=0.5)
    daily = materialize(add_features(flagged, STATUS, bundle.features), "status-days")
    scores = evaluate_interval_forecast(bundle, daily, _weeks_from_file(spark, sf), STATUS_TEST, STATUS)
    cells = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return emit(scores.select("window_idx", cells.alias("cells"), (F.col("fn") + F.col("tp")).alias("positives")))
