"""Wide time-by-entity matrices to tall readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauge_engine.columns import STATIONS, SensorColumns
from gauge_engine.functions.scalars import daynum_to_timestamp, null_if_nan


def melt_matrix(
    wide: DataFrame,
    entities: DataFrame | None = None,
    cols: SensorColumns = STATIONS,
    daynum: str = "t",
    to_seconds: bool = False,
) -> DataFrame:
    """One reading per matrix cell, nulls kept, times decoded from day-numbers.

    ``entities`` carries the attributes. A row's measures are one array, exploded by position;
    a small table gives each position its entity, so the plan is the same for any number of
    columns and the time is decoded once per row.
    """
    names = [c for c in wide.columns if c != daynum]
    measures = F.array(*[F.col(f"`{c.replace('`', '``')}`").cast("double") for c in names])
    tall = wide.select(
        daynum_to_timestamp(daynum, to_seconds).alias(cols.time), F.posexplode(measures).alias("_position", "_measure")
    )
    listed = wide.sparkSession.createDataFrame(list(enumerate(names)), f"_position int, `{cols.entity}` string")
    if entities is not None and cols.attrs:
        attributes = (
            entities.join(F.broadcast(listed), cols.entity, "left_semi")
            .groupBy(cols.entity)
            .agg(*[F.any_value(a, F.lit(True)).alias(a) for a in cols.attrs])
        )
        listed = listed.join(attributes, cols.entity, "left")
    attrs = cols.attrs if entities is not None else ()
    # One row per matrix column, so the cells never shuffle.
    return tall.join(F.broadcast(listed), "_position").select(
        cols.time, cols.entity, *attrs, null_if_nan("_measure").alias(cols.value)
    )
