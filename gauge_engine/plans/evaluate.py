"""Scores of predictions, of training fits and of seed intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import STATIONS, SensorColumns
from gauge_engine.operators.intervals import interval_history, interval_truth
from gauge_engine.operators.metrics import score_histogram, score_row, scored_pairs, scores_by_group
from gauge_engine.operators.models import ModelBundle
from gauge_engine.plans.forecast import score_horizon_bundle
from gauge_engine.session import materialize


def score_predictions(truth: DataFrame, predictions: DataFrame, allow_empty: bool = False) -> DataFrame:
    """One score row over the ids both tables hold; fails when they share none, unless a row
    of n = 0 is asked for."""
    return score_row(score_histogram(scored_pairs(truth, predictions), weight="weight"), allow_empty=allow_empty)


def evaluation_report(**scored: DataFrame) -> DataFrame:
    """One score row per named table of ``y_prob`` and ``y``."""
    rows = [
        score_row(score_histogram(df, "y_prob", "y")).withColumn("split", F.lit(name))
        for name, df in scored.items()
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def evaluate_intervals(
    truth: DataFrame, probabilities: DataFrame, cols: SensorColumns = STATIONS, cutoff: float = 0.5
) -> DataFrame:
    """Scores per interval and overall from daily truth and daily probability vectors.

    ``probabilities`` holds ``window_idx``, the entity and a ``probs`` array.
    """
    paired = truth.join(probabilities, ["window_idx", cols.entity])
    cells = paired.select("window_idx", F.explode(F.arrays_zip("y_days", "probs")).alias("c"))
    flat = cells.select("window_idx", F.col("c.y_days").alias("y_true"), F.col("c.probs").alias("y_prob"))
    return scores_by_group(flat, "window_idx", "y_prob", "y_true", cutoff, strict=True)


def evaluate_interval_forecast(
    bundle: ModelBundle,
    daily: DataFrame,
    intervals: DataFrame,
    entities: Sequence[str],
    cols: SensorColumns = STATIONS,
    cutoff: float = 0.5,
) -> DataFrame:
    """Scores per interval and overall of a horizon bundle on interval histories.

    ``daily`` is flagged and has the bundle's features. The history blocks are found once,
    for the scores and for the truth.
    """
    if bundle.kind != "horizon":
        raise ValueError(f"an interval forecast needs a horizon bundle, not {bundle.kind}")
    blocks = interval_history(daily, intervals, entities, cols, bundle.features, bundle.history)
    blocks = materialize(blocks, "interval-blocks")
    truth = interval_truth(daily, intervals, entities, cols, bundle.history, bundle.horizon, blocks)
    scored = score_horizon_bundle(bundle, blocks, cols, ["window_idx", cols.entity])
    return evaluate_intervals(truth, scored, cols, cutoff)
