"""Tiny series built by hand, and plain-Python reference answers."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

from gauge_engine.columns import SensorColumns, readings_schema

S = SensorColumns()
START = date(2020, 1, 1)
NAN = float("nan")


def days(n: int, start: date = START) -> list[date]:
    return [start + timedelta(days=i) for i in range(n)]


def reading(station: str, day: date, value: float | None, hour: int = 0, lat: float | None = 1.0):
    return (datetime.combine(day, datetime.min.time()) + timedelta(hours=hour), station, lat, 2.0, value)


def readings(spark, rows):
    return spark.createDataFrame(rows, readings_schema(S))


def series(spark, station: str, values, start: date = START):
    """One reading per day."""
    return readings(spark, [reading(station, d, v) for d, v in zip(days(len(values), start), values)])


def mean_of(values):
    kept = [v for v in values if v is not None]
    return sum(kept) / len(kept) if kept else None


def std_of(values):
    kept = [v for v in values if v is not None]
    if len(kept) < 2:
        return None
    m = sum(kept) / len(kept)
    return math.sqrt(sum((v - m) ** 2 for v in kept) / (len(kept) - 1))


def trailing(values, i, rows):
    return values[max(0, i - rows + 1) : i + 1]


def features_of(values):
    """Per day: value, mean of 3, mean of 7, deviation of 7 (0 where undefined)."""
    return [
        (v, mean_of(trailing(values, i, 3)), mean_of(trailing(values, i, 7)), std_of(trailing(values, i, 7)) or 0.0)
        for i, v in enumerate(values)
    ]


def brute_auc(truth, scores):
    pairs = [(p, n) for p, t in zip(scores, truth) if t == 1 for n, u in zip(scores, truth) if u == 0]
    if not pairs:
        return 0.5
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
