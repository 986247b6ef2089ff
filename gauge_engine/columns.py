"""Column roles, window sizes and declared table schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Window sizes and rule constants every caller may override.
HISTORY_DAYS = 7
HORIZON_DAYS = 14
THRESHOLD_STDS = 1.5
DEFAULT_PROBABILITY = 0.5
DECISION_CUTOFF = 0.5

# The published station split.
TRAINING_STATIONS = (
    "Annapolis", "Atlantic_City", "Charleston", "Washington", "Wilmington",
    "Eastport", "Portland", "Sewells_Point", "Sandy_Hook",
)
TESTING_STATIONS = ("Lewes", "Fernandina_Beach", "The_Battery")


@dataclass(frozen=True)
class SensorColumns:
    """Which column plays which role; operators never hard-code a name."""

    entity: str = "station_name"
    time: str = "time"
    value: str = "sea_level"
    attrs: tuple[str, ...] = ("latitude", "longitude")
    date: str = "date"
    threshold: str = "flood_threshold"
    flag: str = "flood"

    @property
    def peak(self) -> str:
        return f"{self.value}_max"

    @property
    def mean_3(self) -> str:
        return f"{self.value}_3d_mean"

    @property
    def mean_7(self) -> str:
        return f"{self.value}_7d_mean"

    @property
    def spread(self) -> str:
        return f"{self.value}_std"

    @property
    def tree_features(self) -> tuple[str, ...]:
        return (self.value, self.mean_3, self.mean_7)

    @property
    def sequence_features(self) -> tuple[str, ...]:
        return (*self.tree_features, self.spread)


STATIONS = SensorColumns()


def readings_schema(cols: SensorColumns = STATIONS) -> T.StructType:
    """Tall readings; the clock carries no zone, so days never depend on the session."""
    fields = [
        T.StructField(cols.time, T.TimestampNTZType()),
        T.StructField(cols.entity, T.StringType()),
        *[T.StructField(a, T.DoubleType()) for a in cols.attrs],
        T.StructField(cols.value, T.DoubleType()),
    ]
    return T.StructType(fields)


def index_schema(cols: SensorColumns = STATIONS) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField(cols.entity, T.StringType()),
            T.StructField("hist_start", T.DateType()),
            T.StructField("hist_end", T.DateType()),
            T.StructField("future_start", T.DateType()),
            T.StructField("future_end", T.DateType()),
        ]
    )


INTERVALS_SCHEMA = T.StructType(
    [T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType())]
)

METRIC_LOG_SCHEMA = T.StructType(
    [
        T.StructField("iter", T.IntegerType()),
        T.StructField("AUC", T.DoubleType()),
        T.StructField("Logloss", T.DoubleType()),
    ]
)

PREDICTIONS_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("y_prob", T.DoubleType())]
)

TRUTH_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("y_true", T.IntegerType())]
)
