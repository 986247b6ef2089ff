"""Training readings, test readings and index to a prediction table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from gauge_engine.columns import STATIONS, THRESHOLD_STDS, SensorColumns
from gauge_engine.functions.arrays import horizon_blend, horizon_max
from gauge_engine.operators.align import align_to_index, constant_predictions
from gauge_engine.operators.daily import add_features, daily_rollup
from gauge_engine.operators.models import (
    BoostingSettings,
    ModelBundle,
    fingerprint,
    fit_boosting,
    fit_horizon,
    load_or_fit,
    score_horizon,
    score_windows,
    validated_fit,
)
from gauge_engine.operators.plugin import HorizonScorer, Scorer, score_horizon_with, score_with
from gauge_engine.operators.scaling import apply_scaler, apply_scaler_flat, fit_scaler
from gauge_engine.operators.splits import split_random, split_stratified, split_tail
from gauge_engine.plans.training import (
    flag_series,
    scoring_windows,
    series_thresholds,
    training_windows,
    windows_of,
)
from gauge_engine.session import materialize
from gauge_engine.sources.sinks import publish_predictions, require_rows

logger = logging.getLogger(__name__)

NO_WINDOWS = "no test windows could be built from the test readings"


def fit_bundle(
    train: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    settings: BoostingSettings = BoostingSettings(),
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
    refit: bool = False,
    split: str = "stratified",
    metric: str = "AUC",
    patience: int | None = None,
    use_best_rounds: bool = True,
) -> ModelBundle:
    """Fit on the training entities only; ``refit`` first chooses the rounds on a split.

    ``split``: ``stratified`` by class, the ``tail`` of the series, or ``random``.
    """
    names = cols.tree_features if features is None else features
    daily = materialize(daily_rollup(train, cols, attrs=(), moments=True), "daily")
    windows = windows_of(flag_series(daily, cols, stds=stds, basis=basis), cols, names)
    if refit:
        keys = [cols.entity, "hist_start"]
        if split == "tail":
            marked = split_tail(windows, keys[1:], cols=cols)
        elif split == "random":
            marked = split_random(windows, keys)
        else:
            marked = split_stratified(windows, keys)
        model = validated_fit(
            marked, "is_validation", settings, metric=metric, patience=patience, use_best_rounds=use_best_rounds
        ).model
    else:
        model = fit_boosting(windows, settings)
    return ModelBundle(
        model,
        names,
        settings,
        stds=stds,
        basis=basis,
        validation=validation_name(refit, split, metric, patience, use_best_rounds),
        trained_on=trained_on(train, cols),
        thresholds=series_thresholds(daily, cols, stds, basis),
    )


def validation_name(refit: bool, split: str, metric: str, patience: int | None, use_best_rounds: bool) -> str:
    """How the number of rounds is chosen, as bundles remember it."""
    return f"{split} {metric} patience {patience} best {use_best_rounds}" if refit else ""


def trained_on(train: DataFrame, cols: SensorColumns) -> str:
    return fingerprint(train, cols.entity, cols.time, cols.value)


def forecast(
    train: DataFrame,
    test: DataFrame,
    index: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    settings: BoostingSettings = BoostingSettings(),
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
    refit: bool = False,
    bundle_path: str | None = None,
    split: str = "stratified",
    metric: str = "AUC",
    patience: int | None = None,
) -> DataFrame:
    """Prediction per index id.

    A bundle at ``bundle_path`` is reused, else fitted and kept. One that was fitted on other
    readings, with other settings or with its rounds chosen in another way is refused.
    """

    def fit() -> ModelBundle:
        return fit_bundle(train, cols, features, settings, stds, basis, refit, split, metric, patience)

    def bundled() -> ModelBundle:
        asked = {"kind": "window", "settings": settings, "stds": stds, "basis": basis}
        asked["features"] = cols.tree_features if features is None else features
        asked["validation"] = validation_name(refit, split, metric, patience, True)
        asked["trained_on"] = trained_on(train, cols)
        return load_or_fit(test.sparkSession, bundle_path, fit, **asked)

    bundle = bundled() if bundle_path else fit()
    windows = require_rows(materialize(scoring_windows(test, cols, bundle.features), "test-windows"), NO_WINDOWS)
    return align_to_index(index, score_windows(bundle.model, windows), cols)


def forecast_horizon(
    train: DataFrame,
    test: DataFrame,
    index: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    settings: BoostingSettings = BoostingSettings(),
    stds: float = THRESHOLD_STDS,
    combine: str = "blend",
    bundle_path: str | None = None,
) -> DataFrame:
    """Prediction per index id from a daily horizon forecast, blended or its maximum.

    A bundle at ``bundle_path`` is reused, else fitted and kept.
    """
    if combine not in ("blend", "max"):
        raise ValueError(f"combine must be 'blend' or 'max', not {combine!r}")
    names = cols.sequence_features if features is None else features

    def fit() -> ModelBundle:
        return fit_horizon_bundle(train, cols, names, settings, stds)

    def bundled() -> ModelBundle:
        asked = {"kind": "horizon", "settings": settings, "stds": stds, "features": names}
        return load_or_fit(test.sparkSession, bundle_path, fit, trained_on=trained_on(train, cols), **asked)

    bundle = bundled() if bundle_path else fit()
    windows = require_rows(materialize(scoring_windows(test, cols, bundle.features), "test-windows"), NO_WINDOWS)
    daily = score_horizon_bundle(bundle, windows, cols)
    return align_to_index(index, _combined(daily, combine, bundle.horizon), cols)


def _combined(daily: DataFrame, combine: str, horizon: int) -> DataFrame:
    """One probability from the daily ones."""
    return daily.withColumn("y_prob", horizon_blend("probs", horizon) if combine == "blend" else horizon_max("probs"))


def training_tables(
    train: DataFrame, cols: SensorColumns, names: Sequence[str], stds: float, basis: str = "raw"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily moments, thresholds and scaler of the training entities; readings are scanned once."""
    daily = materialize(daily_rollup(train, cols, attrs=(), moments=True), "daily")
    scaler = materialize(fit_scaler(add_features(daily, cols, names), cols, names), "scaler")
    return daily, series_thresholds(daily, cols, stds, basis), scaler


def fit_horizon_bundle(
    train: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    settings: BoostingSettings = BoostingSettings(),
    stds: float = THRESHOLD_STDS,
) -> ModelBundle:
    """A horizon model on scaled blocks, with the thresholds and the scaler of its training part."""
    names = cols.sequence_features if features is None else features
    daily, thresholds, scaler = training_tables(train, cols, names, stds)
    windows = windows_of(flag_series(daily, cols, stds=stds), cols, names)
    model = fit_horizon(apply_scaler_flat(windows, scaler, len(names)), settings)
    about = {"kind": "horizon", "stds": stds, "trained_on": trained_on(train, cols)}
    return ModelBundle(model, names, settings, thresholds=thresholds, scaler=scaler, **about)


def score_horizon_bundle(
    bundle: ModelBundle, windows: DataFrame, cols: SensorColumns = STATIONS, keys: Sequence[str] | None = None
) -> DataFrame:
    """Daily probabilities of flat blocks as they were observed; a bundle with a scaler applies it."""
    if bundle.scaler is not None:
        windows = apply_scaler_flat(windows, bundle.scaler, len(bundle.features))
    return score_horizon(bundle.model, windows, cols, bundle.horizon, keys)


def fit_scorer_bundle(
    train: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
) -> ModelBundle:
    """What a user's scorer needs from the training part: its scaler and thresholds."""
    names = cols.sequence_features if features is None else features
    _, thresholds, scaler = training_tables(train, cols, names, stds, basis)
    about = {"kind": "scorer", "stds": stds, "basis": basis, "trained_on": trained_on(train, cols)}
    return ModelBundle(None, names, thresholds=thresholds, scaler=scaler, **about)


def scorer_training_windows(
    bundle: ModelBundle, train: DataFrame, cols: SensorColumns = STATIONS
) -> DataFrame:
    """Labelled, scaled matrix blocks on which a user fits the scorer of a bundle."""
    windows = training_windows(train, cols, bundle.features, bundle.thresholds, layout="matrix")
    return apply_scaler(windows, bundle.scaler)


def forecast_horizon_with(
    scorer: HorizonScorer,
    train: DataFrame,
    test: DataFrame,
    index: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    stds: float = THRESHOLD_STDS,
    basis: str = "raw",
    combine: str = "blend",
    bundle_path: str | None = None,
) -> DataFrame:
    """Prediction per index id from a user's horizon scorer.

    The scorer sees blocks standardised with the training part's scaler; its daily
    probabilities are blended, or their maximum taken. Scaler and thresholds are kept in the
    bundle at ``bundle_path`` and read from there the next time.
    """
    if combine not in ("blend", "max"):
        raise ValueError(f"combine must be 'blend' or 'max', not {combine!r}")
    names = cols.sequence_features if features is None else features

    def fit() -> ModelBundle:
        return fit_scorer_bundle(train, cols, names, stds, basis)

    def bundled() -> ModelBundle:
        asked = {"kind": "scorer", "stds": stds, "basis": basis, "features": names}
        return load_or_fit(test.sparkSession, bundle_path, fit, trained_on=trained_on(train, cols), **asked)

    bundle = bundled() if bundle_path else fit()
    blocks = scoring_windows(test, cols, bundle.features, layout="matrix")
    windows = require_rows(materialize(blocks, "test-windows"), NO_WINDOWS)
    scaled = apply_scaler(windows, bundle.scaler)
    daily = score_horizon_with(scaled, scorer, cols, bundle.features, bundle.history, bundle.horizon)
    return align_to_index(index, _combined(daily, combine, bundle.horizon), cols)


def publish_forecast(
    index: DataFrame, predict: Callable[[], DataFrame], path: str, fmt: str = "csv"
) -> bool:
    """Write what ``predict`` yields; if it fails, write the constant table instead.

    Planning and running both count as ``predict``: Spark reports many errors only when
    the table is written. Returns whether the predictions themselves were written.
    """
    try:
        publish_predictions(predict(), path, fmt, mode="overwrite")
    except Exception:
        logger.exception("prediction failed; writing the constant table")
        publish_predictions(constant_predictions(index), path, fmt, mode="overwrite")
        return False
    return True


def forecast_with(
    scorer: Scorer,
    test: DataFrame,
    index: DataFrame,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Prediction per index id from a user-supplied scorer."""
    windows = scoring_windows(test, cols, features)
    return align_to_index(index, score_with(windows, scorer, cols), cols)
