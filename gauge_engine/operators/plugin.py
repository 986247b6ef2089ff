"""User-supplied scorers: the one place where Python sees the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gauge_engine.columns import HISTORY_DAYS, HORIZON_DAYS, STATIONS, SensorColumns

# Rows of flat blocks to one probability a row.
Scorer = Callable[[np.ndarray], np.ndarray]
# Rows of matrix blocks (rows x steps x features) to one probability a row and horizon day.
HorizonScorer = Callable[[np.ndarray], np.ndarray]


def score_with(windows: DataFrame, scorer: Scorer, cols: SensorColumns = STATIONS) -> DataFrame:
    """Apply ``scorer`` (rows of flat blocks in, one probability per row out) in Arrow batches.

    Only the window key and the block cross into Python, and only the key and the
    probability come back.
    """
    keys = [cols.entity, "hist_start", "future_start"]
    source = windows.select(*keys, "x")
    schema = T.StructType(
        [*[source.schema[k] for k in keys], T.StructField("y_prob", T.DoubleType())]
    )

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = batch.column(batch.schema.get_field_index("x"))
            matrix = block.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = np.asarray(scorer(matrix), dtype="float64")
            if scores.shape != (batch.num_rows,):
                raise ValueError("a scorer must return one probability per row")
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*keys, "y_prob"])

    return source.mapInArrow(score_batches, schema)


def matrix_batch(blocks: pa.ListArray, steps: int, width: int) -> np.ndarray:
    """Nested lists of one batch as rows x steps x features, without a copy per row.

    Fails unless every block has ``steps`` steps of ``width`` features. Null features are NaN.
    """
    inner = blocks.flatten()
    regular = (
        blocks.null_count == 0
        and inner.null_count == 0
        and np.all(np.diff(blocks.offsets.to_numpy()) == steps)
        and np.all(np.diff(inner.offsets.to_numpy()) == width)
    )
    if not regular:
        raise ValueError(f"a history block is not {steps} steps of {width} features")
    return inner.flatten().to_numpy(zero_copy_only=False).reshape(len(blocks), steps, width)


def score_horizon_with(
    windows: DataFrame,
    scorer: HorizonScorer,
    cols: SensorColumns = STATIONS,
    features: Sequence[str] | None = None,
    history: int = HISTORY_DAYS,
    horizon: int = HORIZON_DAYS,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Apply ``scorer`` to matrix blocks and get the ``probs`` of all horizon days back.

    Blocks cross as nested Arrow lists and the scorer sees one array of a batch. What it
    returns must be rows x ``horizon``; a missing or infinite number fails, as nothing behind
    could tell it from a score. ``keys`` name a window, by default its entity and dates.
    """
    names = list(cols.sequence_features if features is None else features)
    keys = list(keys or (cols.entity, "hist_start", "future_start"))
    source = windows.select(*keys, "x")
    probs = T.StructField("probs", T.ArrayType(T.DoubleType(), False), False)
    schema = T.StructType([*[source.schema[k] for k in keys], probs])

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = batch.column(batch.schema.get_field_index("x"))
            scores = np.asarray(scorer(matrix_batch(block, history, len(names))), dtype="float64")
            if scores.shape != (batch.num_rows, horizon):
                raise ValueError(f"a horizon scorer must return {horizon} probabilities per row, not {scores.shape}")
            if not np.isfinite(scores).all():
                raise ValueError("a horizon scorer returned a missing or infinite probability")
            offsets = pa.array(np.arange(0, scores.size + 1, horizon, dtype="int32"))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, vectors], names=[*keys, "probs"])

    return source.mapInArrow(score_batches, schema)
