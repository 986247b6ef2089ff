"""Column expressions on history blocks and horizon vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gauge_engine.functions.scalars import _col


def flatten_block(matrix: Column | str) -> Column:
    """History matrix (steps of features) to one time-major vector."""
    return F.flatten(_col(matrix))


def reshape_block(vector: Column | str, width: int) -> Column:
    """Time-major vector back to steps of ``width`` features."""
    v = _col(vector)
    starts = F.sequence(F.lit(1), F.size(v) - (width - 1), F.lit(width))
    return F.transform(starts, lambda i: F.slice(v, i, width))


def scale_block(matrix: Column | str, mean: Column | str, std: Column | str) -> Column:
    """Standardise every step; ``mean`` and ``std`` are arrays in feature order."""
    m, s = _col(mean), _col(std)
    return F.transform(
        _col(matrix),
        lambda step: F.zip_with(F.zip_with(step, m, lambda x, a: x - a), s, lambda x, b: x / b),
    )


def horizon_max(probs: Column | str) -> Column:
    return F.array_max(_col(probs))


def horizon_weights(length: int, low: float = 0.5, high: float = 1.5) -> Sequence[float]:
    """Evenly spaced weights from ``low`` to ``high``."""
    if length == 1:
        return [low]
    return [low + (high - low) * i / (length - 1) for i in range(length)]


def horizon_blend(
    probs: Column | str,
    length: int = 14,
    low: float = 0.5,
    high: float = 1.5,
    mean_share: float = 0.6,
) -> Column:
    """Weighted mean over the horizon (later days count more) blended with its maximum."""
    p = _col(probs)
    weights = horizon_weights(length, low, high)
    weighted = F.aggregate(
        F.zip_with(p, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return mean_share * (weighted / sum(weights)) + (1.0 - mean_share) * F.array_max(p)


def zero_horizon(length: int = 14) -> Column:
    return F.array_repeat(F.lit(0), length)
