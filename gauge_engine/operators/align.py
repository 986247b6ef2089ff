"""Bringing predictions back to the rows that were asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import DEFAULT_PROBABILITY, STATIONS, SensorColumns


def align_to_index(
    index: DataFrame,
    predictions: DataFrame,
    cols: SensorColumns = STATIONS,
    default: float = DEFAULT_PROBABILITY,
) -> DataFrame:
    """Left join on the typed window key; an index row without a window gets ``default``."""
    keys = [cols.entity, "hist_start", "future_start"]
    found = index.select("id", *keys).join(predictions.select(*keys, "y_prob"), keys, "left")
    return found.select("id", F.coalesce("y_prob", F.lit(default)).alias("y_prob"))


def complete_predictions(
    index: DataFrame, predictions: DataFrame, default: float = DEFAULT_PROBABILITY
) -> DataFrame:
    """Every index id exactly as given, with ``default`` where nothing was predicted."""
    found = index.select("id").join(predictions.select("id", "y_prob"), "id", "left")
    return found.select("id", F.coalesce("y_prob", F.lit(default)).alias("y_prob"))


def constant_predictions(index: DataFrame, value: float = DEFAULT_PROBABILITY) -> DataFrame:
    """The same probability for every id: the stand-in when no model is available."""
    return index.select("id", F.lit(value).alias("y_prob"))
