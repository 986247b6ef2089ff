"""Column expressions on single values; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the year-0 day-number of 1970-01-01.
UNIX_EPOCH_DAYNUM = 719529
MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    """Spark's aggregates do not skip NaN, so every measure passes here once."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def daynum_to_timestamp(daynum: Column | str, to_seconds: bool = False) -> Column:
    """Year-0 day-number to a zone-free timestamp, optionally rounded to whole seconds."""
    micros = F.round((_col(daynum) - UNIX_EPOCH_DAYNUM) * MICROS_PER_DAY)
    if to_seconds:
        micros = F.round(micros / 1_000_000) * 1_000_000
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def event_flag(peak: Column | str, threshold: Column | str) -> Column:
    """1 when the peak exceeds the threshold; a missing side counts as no event."""
    return F.coalesce(_col(peak) > _col(threshold), F.lit(False)).cast("int")


def binarize(score: Column | str, cutoff: float = 0.5, strict: bool = False) -> Column:
    """0/1 decision at ``cutoff``; a missing score decides 0."""
    c = null_if_nan(score)
    hit = c > cutoff if strict else c >= cutoff
    return F.coalesce(hit, F.lit(False)).cast("int")


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def iso_date(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyy-MM-dd")


def composite_key(entity: Column | str, hist_start: Column | str, future_start: Column | str) -> Column:
    """Text form of the window key. Joins use the typed columns instead."""
    return F.concat_ws("|", _col(entity).cast("string"), iso_date(hist_start), iso_date(future_start))


def class_weight(label: Column | str, positive_weight: Column | float) -> Column:
    weight = positive_weight if isinstance(positive_weight, Column) else F.lit(float(positive_weight))
    return F.when(_col(label) == 1, weight).otherwise(F.lit(1.0))
