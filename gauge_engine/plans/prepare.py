"""Matrix to training readings, test readings and test index."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gauge_engine.columns import STATIONS, TESTING_STATIONS, TRAINING_STATIONS, SensorColumns
from gauge_engine.operators.daily import daily_slim
from gauge_engine.operators.index import index_with_ids
from gauge_engine.operators.splits import keep_listed_entities, split_entities
from gauge_engine.session import scratch_path
from gauge_engine.sources.matrix import melt_matrix
from gauge_engine.sources.sinks import store_by_entity, write_table


@dataclass
class Dataset:
    train: DataFrame
    test: DataFrame
    index: DataFrame

    def write(self, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()) -> None:
        """Write the three tables.

        Partitioning readings by entity lets entity filters prune folders; it suits up to
        some thousands of entities, as every entity becomes a folder.
        """
        write_table(self.train, f"{path}/train", fmt, partition_by)
        write_table(self.test, f"{path}/test", fmt, partition_by)
        write_table(self.index, f"{path}/index", fmt)


def prepare_dataset(
    wide: DataFrame,
    entities: DataFrame | None = None,
    train: Iterable[str] = TRAINING_STATIONS,
    test: Iterable[str] = TESTING_STATIONS,
    cols: SensorColumns = STATIONS,
    to_seconds: bool = False,
) -> Dataset:
    readings = melt_matrix(wide, entities, cols, to_seconds=to_seconds)
    train_readings, test_readings = split_entities(readings, train, test, cols)
    return Dataset(train_readings, test_readings, index_with_ids(daily_slim(test_readings, cols), cols))


def prepare_listed(
    wide: DataFrame,
    train: DataFrame,
    test: DataFrame,
    entities: DataFrame | None = None,
    cols: SensorColumns = STATIONS,
    to_seconds: bool = False,
    path: str | None = None,
) -> Dataset:
    """The same with the entity lists as tables.

    The matrix is melted once and stored by entity at ``path`` (else in the shared folder);
    the lists prune its folders. Entities that a list repeats count once, and names that are
    not in the matrix have no readings.
    """
    readings = store_by_entity(
        melt_matrix(wide, entities, cols, to_seconds=to_seconds), path or scratch_path(wide.sparkSession, "melted"), cols
    )
    train_readings, test_readings = (keep_listed_entities(readings, names, cols) for names in (train, test))
    return Dataset(train_readings, test_readings, index_with_ids(daily_slim(test_readings, cols), cols))
