"""Splitting a long daily series into overlapping segments.

Row frames need consecutive rows, so a segment carries copies of its neighbours' rows:
enough before it for the rolling features, enough after it for history and horizon. The
answers are those of the unsplit series; the parallelism is entities times segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauge_engine.columns import STATIONS, SensorColumns

SEGMENT = "_segment"
HOME = "_home_segment"


def row_ordinals(daily: DataFrame, cols: SensorColumns = STATIONS, name: str = "ordinal") -> DataFrame:
    """0-based row number inside an entity, from month counts instead of one long sort."""
    dated = daily.withColumn("_month", F.trunc(cols.date, "month"))
    months = dated.groupBy(cols.entity, "_month").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = (
        Window.partitionBy(cols.entity)
        .orderBy("_month")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    months = months.select(
        cols.entity, "_month", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    in_month = Window.partitionBy(cols.entity, "_month").orderBy(cols.date)
    return (
        dated.withColumn("_in_month", F.row_number().over(in_month) - 1)
        .join(months, [cols.entity, "_month"])
        .withColumn(name, F.col("_before") + F.col("_in_month"))
        .drop("_month", "_before", "_in_month")
    )


def split_into_segments(
    daily: DataFrame,
    cols: SensorColumns = STATIONS,
    rows: int = 4096,
    before: int = 6,
    after: int = 20,
) -> DataFrame:
    """Assign every row to its segment and copy boundary rows into the neighbours.

    ``before`` is how many earlier rows the frames look back, ``after`` how many they look
    ahead. Rows whose ``HOME`` differs from ``SEGMENT`` are copies; drop them at the end.
    """
    if rows <= max(before, after):
        raise ValueError("a segment must be longer than its overlap")
    numbered = row_ordinals(daily, cols, "_ordinal")
    home = F.floor(F.col("_ordinal") / rows)
    offset = F.col("_ordinal") % rows
    targets = F.array(
        home,
        F.when((home > 0) & (offset < after), home - 1),
        F.when(offset >= rows - before, home + 1),
    )
    return (
        numbered.withColumn(HOME, home)
        .withColumn(SEGMENT, F.explode(F.array_compact(targets)))
        .drop("_ordinal")
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Only the rows that belong to their segment."""
    return df.filter(F.col(SEGMENT) == F.col(HOME)).drop(SEGMENT, HOME)
